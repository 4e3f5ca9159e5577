from .ingest import (counts_table, latest, run_available, running_counts, stream_lines,
                     stream_release)

__all__ = ["counts_table", "latest", "run_available", "running_counts", "stream_lines",
           "stream_release"]
