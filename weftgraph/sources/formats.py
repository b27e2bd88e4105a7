"""Results as text: tables, JSON envelopes and JSON lines, with a row cap."""

from __future__ import annotations

import datetime
import json
import math
import os
import tomllib

from pyspark.sql import DataFrame, Row

#: Rows that a result shows, unless the environment or an option says otherwise.
DEFAULT_ROWS = int(os.environ.get("WEFTGRAPH_MAX_ROWS") or 1_000)
CELL_BYTES = 60


def bounded(df: DataFrame, cap: int | None = DEFAULT_ROWS) -> tuple[list[str], list[Row], bool]:
    """Columns, at most ``cap`` rows, and whether there were more."""
    rows = df.limit(cap + 1).collect() if cap is not None else df.collect()
    more = cap is not None and len(rows) > cap
    return df.columns, rows[:cap] if more else rows, more


def plain(v):
    """A value as JSON has it: non-finite numbers, bytes and times as text."""
    if isinstance(v, float) and not math.isfinite(v):
        return "NaN" if math.isnan(v) else "inf" if v > 0 else "-inf"
    if isinstance(v, (bytes, bytearray)):
        return repr(bytes(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat() + ("Z" if isinstance(v, datetime.datetime) else "")
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def _cell(v) -> str:
    text = "null" if v is None else v if isinstance(v, str) else json.dumps(plain(v), ensure_ascii=False, default=str)
    text = text.replace("\n", "\\n")
    raw = text.encode()
    return text if len(raw) <= CELL_BYTES else raw[: CELL_BYTES - 3].decode("utf-8", "ignore") + "..."


def as_table(df: DataFrame, cap: int | None = DEFAULT_ROWS) -> str:
    """Padded columns; long cells are cut."""
    cols, rows, _ = bounded(df, cap)
    cells = [[_cell(v) for v in r] for r in rows]
    width = [max([len(c), *[len(r[k]) for r in cells]]) for k, c in enumerate(cols)]
    line = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()
    return "\n".join([line(cols), "-+-".join("-" * w for w in width), *map(line, cells)])


def as_json(results: list[DataFrame], command: str = "query", cap: int | None = DEFAULT_ROWS) -> str:
    out = []
    for df in results:
        cols, rows, more = bounded(df, cap)
        out.append({"columns": cols, "row_count": len(rows), "truncated": more, "rows": [[plain(v) for v in r] for r in rows]})
    return json.dumps({"ok": True, "command": command, "policy": {"max_rows": cap}, "results": out}, ensure_ascii=False)


def as_ndjson(results: list[DataFrame], command: str = "query", cap: int | None = DEFAULT_ROWS) -> str:
    lines = [{"kind": "meta", "command": command, "max_rows": cap}]
    for no, df in enumerate(results):
        cols, rows, more = bounded(df, cap)
        lines.append({"kind": "result", "index": no, "columns": cols, "row_count": len(rows), "truncated": more})
        lines += [{"kind": "row", "index": no, "values": [plain(v) for v in r]} for r in rows]
    return "\n".join(json.dumps(x, ensure_ascii=False) for x in lines)


def params(text: str | None = None, path: str | None = None) -> dict:
    """Query parameters from JSON text or a file."""
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    out = json.loads(text) if text else {}
    if not isinstance(out, dict):
        raise ValueError("parameters must be a JSON object")
    return out


def config(path: str) -> dict:
    """Workspace settings of a TOML file: ``db_path``, ``markdown_root``, ``include_fs_graph``.

    A file that is not there gives none.  Relative paths count from its folder.
    """
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        found = tomllib.load(f)
    flat = found | found.get("package", {}) | found.get("markdown", {})
    home = os.path.dirname(os.path.abspath(path))
    out = {k: flat[k] for k in ("db_path", "markdown_root", "include_fs_graph") if k in flat}
    return out | {k: os.path.normpath(os.path.join(home, out[k])) for k in ("db_path", "markdown_root") if k in out}
