"""Report sink: an ordered text document per run date, and the same as ``latest``."""
from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(document: DataFrame, root: str, run_date: str) -> str:
    """Write the ordered document rows as text to ``<root>/<run_date>`` and ``<root>/latest``.

    Part files in name order are the document; nothing is gathered into one task. The
    report rows are a written table, so the second copy costs one more sort of them and
    nothing is kept on executors.
    """
    text = document.select("text")
    dated = f"{root}/{run_date}"
    for path in (dated, f"{root}/latest"):
        text.write.mode("overwrite").text(path)
    return dated
