"""Readers (``files``) and writers (``sinks``) for filings, delimited and
positional tables, JSON documents and lines, logs and reports."""
