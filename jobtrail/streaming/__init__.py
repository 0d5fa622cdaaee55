from jobtrail.streaming.arrivals import collect_counts, run_available
from jobtrail.streaming.load import finish_load_stream, late_rows, run_load_stream, stream_loads

__all__ = ["collect_counts", "finish_load_stream", "late_rows", "run_available", "run_load_stream", "stream_loads"]
