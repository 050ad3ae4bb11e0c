"""Writers: tables, exports and messages."""
