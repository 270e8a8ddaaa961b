"""Settings and reports of the driver: environment files, experiments, run folders, tables for people."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from datetime import datetime
from pathlib import Path


def read_env(text: str, known: Mapping[str, str]) -> dict[str, str]:
    """KEY=VALUE lines that are not known already; comments and blank lines skipped, quotes around values dropped."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        key, equals, value = line.strip().partition("=")
        if equals and key and not key.startswith("#") and key.strip() not in known:
            out.setdefault(key.strip(), value.strip().strip("\"'"))
    return out


@dataclass(frozen=True)
class Experiment:
    """One evaluation setup; the agent engine implies the AGENT layer."""

    name: str
    engine: str = "direct"
    layer: str = "L0"
    thinking: str = "slow"
    budget_scale: float = 1.0
    batch_size: int = 32
    retrieval_k: int = 5
    dimensions: tuple[str, ...] = field(default=())

    @classmethod
    def read(cls, settings: Mapping[str, object]) -> Experiment:
        if not isinstance(settings, Mapping) or not settings.get("name"):
            raise ValueError("an experiment is a mapping with a name")
        unknown = set(settings) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(map(str, unknown)))}")
        made = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})
        if made.engine not in ("direct", "agent") or made.budget_scale <= 0 or made.retrieval_k < 1 or made.batch_size < 1:
            raise ValueError("engine is direct or agent; scale, k and batch size are positive")
        return cls(**{**made.__dict__, "layer": "AGENT"}) if made.engine == "agent" else made


def canonical(value: object) -> str:
    """JSON with sorted keys, for fingerprints."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=list)


def run_name(name: str, settings: object, at: datetime) -> str:
    return f"{at:%Y%m%dT%H%M%S}-{name}-{hashlib.sha1(canonical(settings).encode()).hexdigest()[:8]}"


def new_run(root: Path, name: str) -> Path:
    """A run's folder, which must not exist yet."""
    path = root / name
    path.mkdir(parents=True, exist_ok=False)
    return path


def archive(report: Path, folder: Path, index_row: str) -> bool:
    """Copies a report unless it is there already, and adds a row to the index if it was not."""
    target = folder / report.name
    folder.mkdir(parents=True, exist_ok=True)
    if target.exists():
        return False
    target.write_bytes(report.read_bytes())
    with (folder / "INDEX.md").open("a", encoding="utf-8") as out:
        out.write(index_row.rstrip("\n") + "\n")
    return True


def width(text: str) -> int:
    """Columns on a terminal: wide East Asian characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def padded(text: str, columns: int) -> str:
    return text + " " * max(0, columns - width(text))


def bar(done: int, total: int, columns: int = 20) -> str:
    full = round(columns * done / total) if total else 0
    return "█" * full + "░" * (columns - full)


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def duration_text(seconds: float) -> str:
    """Seconds below a minute, then minutes and seconds, then hours and minutes."""
    whole = max(0, int(seconds))
    if whole < 60:
        return f"{whole}s"
    return f"{whole // 60}m{whole % 60:02d}s" if whole < 3600 else f"{whole // 3600}h{whole % 3600 // 60:02d}m"


def markdown_table(columns: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    """A table of a summary that has been collected; null shows as a dash."""
    shown = [[("—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|") for v in r] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [list(columns), ["---"] * len(columns), *shown])


def tool_catalog(tools: Iterable[Mapping]) -> str:
    """A line for each tool: name, arguments with their types (optional ones marked), first sentence of its description."""
    lines = []
    for t in tools:
        spec = t.get("function", t)
        given = spec.get("parameters", {})
        named = []
        for arg, kind in given.get("properties", {}).items():
            of = kind.get("type", "any")
            of = f"{kind.get('items', {}).get('type', 'any')}[]" if of == "array" else of
            named.append(f"{arg}: {of}" + ("" if arg in given.get("required", []) else "（可选）"))
        about = spec.get("description", "").split("。")[0].split("\n")[0].strip()
        lines.append(f"- {spec['name']}({', '.join(named)})" + (f"：{about}" if about else ""))
    return "\n".join(lines)


def content_text(content: object) -> str:
    """A message's text, be it plain or a list of blocks."""
    if isinstance(content, str):
        return content
    parts = [b if isinstance(b, str) else str(b.get("text", "")) for b in content or [] if isinstance(b, str) or b.get("type") == "text"]
    return "\n".join(parts)
