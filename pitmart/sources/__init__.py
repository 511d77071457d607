"""Raw vendor frames as typed facts and refused rows, and the sinks that hold them."""
