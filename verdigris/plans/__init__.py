"""All queries; importing the package registers them."""

from verdigris.plans import aggregates, courts, imports, joins, legal, records, runs, sampling, scans, stores, tasks, text, windows

__all__ = ["aggregates", "courts", "imports", "joins", "legal", "records", "runs", "sampling", "scans", "stores", "tasks", "text", "windows"]
