from runweave.streaming.completeness import completeness_stream, findings_report
from runweave.streaming.events import source_events
from runweave.streaming.live import live_sources, session_stream, source_sessions
from runweave.streaming.runs import stream_runs, stream_to_store

__all__ = ["completeness_stream", "findings_report", "live_sources", "session_stream", "source_events", "source_sessions", "stream_runs", "stream_to_store"]
