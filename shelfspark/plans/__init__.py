"""The reports: composite plans over a snapshot."""
