"""Plan shapes shared by the operators: skew-safe joins, blocked scans, pointer rounds."""
