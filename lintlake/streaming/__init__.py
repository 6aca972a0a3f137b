from lintlake.streaming.watch import (
    Refresh, debounce, latest_versions, match_changed, stream_files, stream_issues,
    stream_refresh,
)

__all__ = [
    "Refresh", "debounce", "latest_versions", "match_changed", "stream_files", "stream_issues",
    "stream_refresh",
]
