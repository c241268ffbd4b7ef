"""Query classification, planning and the catalogue of named queries."""
