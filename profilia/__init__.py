"""profilia: profile analytics for large collections of ragged monthly series, on Spark."""
