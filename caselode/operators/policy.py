"""Hash policy of a case, and reports made of small tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: The algorithms offered and the default.
ALGORITHMS = ("md5", "sha1", "sha256", "sha512", "blake2b")
DEFAULT = ("sha256", ("md5",))


@dataclass(frozen=True)
class HashPolicy:
    primary: str = DEFAULT[0]
    extras: tuple[str, ...] = DEFAULT[1]

    def algorithms(self) -> tuple[str, ...]:
        """Primary first, none twice."""
        return tuple(dict.fromkeys((self.primary, *self.extras)))

    def to_json(self) -> str:
        return json.dumps({"extras": list(self.extras), "primary": self.primary}, sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str | None) -> HashPolicy:
        """The default for missing, broken or unknown settings."""
        try:
            value = json.loads(text or "")
            out = cls(value["primary"], tuple(value.get("extras", ())))
        except (ValueError, KeyError, TypeError):
            return cls()
        return out if set(out.algorithms()) <= set(ALGORITHMS) else cls()


WIDTH = 78


def _field(name: str, value: object) -> str:
    return f"  {name:<24} {'(none)' if value in (None, '') else value}"


def text_report(segments: DataFrame, summary: DataFrame, title: str, case: dict[str, str] | None = None, metadata: DataFrame | None = None, missing: DataFrame | None = None, notes: str = "", generated: str = "") -> str:
    """A plain report of image sets: the case, then for each set its summary, header fields, segments and faults.

    Deterministic: the time is given as text. case: names and values. metadata: image_set, field, value.
    missing: image_set, number, extension. All tables are small (segments of one case); they come in order, row by row.
    """
    by_set: dict[str, dict[str, list[str]]] = {}

    def collect(part: str, df: DataFrame | None, order: list[str], line) -> None:
        for r in df.orderBy("image_set", *order).toLocalIterator() if df is not None else ():
            by_set.setdefault(r["image_set"], {}).setdefault(part, []).append(line(r))

    collect("Header fields", metadata, ["field", "value"], lambda r: _field(r["field"], r["value"]))
    collect("Segments", segments, ["number", "path"], lambda r: f"  {r['path'].rsplit('/', 1)[-1]:<24} {r['family']:<8} {r['status']:<4} {'; '.join(r['notes'])}".rstrip())
    collect("Missing segments", missing, ["number"], lambda r: f"  {r['number']:<4} {r['extension']}")
    lines = [title, "=" * WIDTH, *(_field(k, v) for k, v in (case or {}).items()), *([_field("Generated", generated)] if generated else [])]
    lines += ["", "Notes", *(f"  {x}" for x in notes.splitlines())] if notes else []
    for s in summary.orderBy("image_set").toLocalIterator():
        verdict = "COMPLETE" if s["complete"] else "INCOMPLETE"
        lines += ["", "-" * WIDTH, f"{s['image_set']}: {verdict}, {s['segments']} segments, {s['bad']} bad, {s['missing']} missing"]
        for part in ("Header fields", "Segments", "Missing segments"):
            if rows := by_set.get(s["image_set"], {}).get(part):
                lines += ["", part, *rows]
    return "\n".join([*lines, ""])
