"""Scans and sinks: uploads (O1), TEI (O2), the paper store."""
