"""Writers: stored tables, CSV exports, the run log."""

from marketlake.sinks.bucketed import load_bucketed, save_bucketed
from marketlake.sinks.exports import export_bars, export_report
from marketlake.sinks.runs import log_run
from marketlake.sinks.tables import save_bars, save_table

__all__ = ["export_bars", "export_report", "load_bucketed", "log_run", "save_bars", "save_bucketed", "save_table"]
