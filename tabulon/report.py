"""What running a plan took."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Report:
    """Counts are partial where a limit ended the scan early."""

    file_bytes: int
    records: int
    bad_rows: int
    quarantined: int
    workers: int
    partitions: int
    seconds: float
    groups: int
    rows_after_filter: int
    limited: bool = False
    baseline_seconds: float | None = None

    @property
    def throughput(self) -> float:
        """MiB a second."""
        return self.file_bytes / self.seconds / (1 << 20) if self.seconds > 0 else 0.0

    @property
    def speedup(self) -> float | None:
        return self.baseline_seconds / self.seconds if self.baseline_seconds and self.seconds > 0 else None

    @property
    def efficiency(self) -> float | None:
        return self.speedup / self.workers if self.speedup and self.workers else None

    def to_text(self) -> str:
        lines = [f"{self.records} records, {self.bad_rows} bad, {self.rows_after_filter} after the filter, {self.groups} groups", f"{self.seconds:.3f} s, {self.throughput:.1f} MiB/s, {self.workers} workers"]
        return "\n".join([*lines, *([f"speedup {self.speedup:.2f}, efficiency {self.efficiency:.2f}"] if self.speedup else [])])
