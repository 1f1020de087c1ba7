"""Vellum: bulk screening of identity-document records, expressed as Spark jobs."""
