"""Scripts: loading, checking, planning and running."""
