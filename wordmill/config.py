"""Settings of a word count, checked once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CountConfig:
    """``buckets``: parts of the result; ``processes``: outer parts in the two-level view;
    ``max_bytes``: longest word kept, None for no guard; ``line_limit``: cut lines into
    rows of that many bytes, None to keep them whole; ``strip``: "all" or "once";
    ``rows_per_file``: rows of a written file before the next one starts."""

    buckets: int = 8
    processes: int = 16
    max_bytes: int | None = 70
    line_limit: int | None = None
    strip: str = "all"
    rows_per_file: int = 5000

    def __post_init__(self) -> None:
        for name in ("buckets", "processes", "rows_per_file"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.max_bytes is not None and self.max_bytes < 1:
            raise ValueError("max_bytes must be at least 1")
        if self.line_limit is not None and self.line_limit < 2:
            raise ValueError("line_limit must be at least 2")
        if self.strip not in ("all", "once"):
            raise ValueError("strip must be all or once")
