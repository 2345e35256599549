"""Reports: titled sections, text and JSON renderers, exporters."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class ReportSection:
    title: str
    content: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class TitledReport:
    title: str
    sections: tuple[ReportSection, ...] = ()

    def to_dict(self) -> dict[str, Any]:
        return {"title": self.title, "sections": [{"title": s.title, "content": s.content} for s in self.sections]}


class ReportEngine:
    def run(self, data: Mapping[str, Any], title: str = "Data quality report") -> TitledReport:
        """Each key of a mapping becomes a section."""
        if not isinstance(data, Mapping):
            raise TypeError("a mapping of sections is needed")
        return TitledReport(title, tuple(ReportSection(str(k).replace("_", " ").title(), v if isinstance(v, dict) else {"value": v}) for k, v in data.items()))


def _dict(report: Any) -> dict[str, Any]:
    return report.to_dict() if hasattr(report, "to_dict") else dict(report)


class JSONRenderer:
    def __init__(self, indent: int | None = 2):
        self.indent = indent

    def render(self, report: Any) -> str:
        from ..operators.inspect import plain

        return json.dumps(plain(_dict(report)), indent=self.indent)


class TextRenderer:
    def render(self, report: Any) -> str:
        lines: list[str] = []

        def walk(x: Any, depth: int) -> None:
            pad = "  " * depth
            for k, v in x.items() if isinstance(x, Mapping) else enumerate(x, 1):
                if isinstance(v, (Mapping, list, tuple)) and v:
                    lines.append(f"{pad}{k}:")
                    walk(v, depth + 1)
                else:
                    lines.append(f"{pad}{k}: {v}")

        walk(_dict(report), 0)
        return "\n".join(lines)


class StringExporter:
    def export(self, report: Any, renderer: Any = None) -> str:
        return (renderer or TextRenderer()).render(report)


class FileExporter:
    def __init__(self, path: str | Path):
        self.path = Path(path)

    def export(self, report: Any, renderer: Any = None) -> Path:
        renderer = renderer or (JSONRenderer() if self.path.suffix == ".json" else TextRenderer())
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(renderer.render(report), encoding="utf-8")
        return self.path
