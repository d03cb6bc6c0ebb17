"""The kept bridge between rules and techniques: source, id, technique and its lower-cased form, clustered by the latter.

Filters by technique, roll-ups and gaps read it instead of exploding all rules; after a new version of the rules only the
rules that changed are exploded again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.store.snapshots import SnapshotTable, Version, keyed, same_key

COLUMNS = ("source", "id", "technique", "folded")


def bridge_table(rules: SnapshotTable) -> SnapshotTable:
    """The bridge that belongs to a table of rules, kept beside its files."""
    key = ("folded", "technique", "source", "id", "place")
    return SnapshotTable(rules.spark, f"{rules.path}/bridge", key=key, cluster=("folded", "source", "id"), rows_per_file=10_000_000)


def exploded(rows: DataFrame, column: str) -> DataFrame:
    """One row per tag; ``place`` tells tags apart that a rule repeats. Null tags do not count."""
    tags = rows.select("source", "id", F.posexplode(column).alias("place", "technique"))
    return tags.where("technique is not null").select("source", "id", "technique", F.lower("technique").alias("folded"), "place")



def _seen(bridge: SnapshotTable) -> int:
    """The version of the rules that the bridge has taken in, -1 before any."""
    fs, path = bridge._fs("seen")
    if not fs.exists(path):
        return -1
    return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=-1)


def refresh_bridge(rules: SnapshotTable, column: str = "mitre_techniques") -> Version | None:
    """Bring the bridge up to the newest version of the rules; None where nothing changed.

    The rules that versions since the last refresh touched are looked up and exploded; their old rows go. A refresh that
    fails before its mark is set is done again and changes nothing then.
    """
    bridge, now = bridge_table(rules), rules.version()
    seen = _seen(bridge)
    if seen >= now.number:
        return None
    rows = rules.read(version=now).select("source", "id", column)
    scope = None
    changed = rules.changes_since(seen) if seen >= 0 else None
    if changed is None and bridge.version() is not None:  # versions expired, or a first refresh failed before its mark
        scope = bridge.read().select("source", "id").distinct()
    elif changed is not None:
        scope = changed.select("source", "id")
        touched, names = keyed(scope, ("source", "id"))
        rows = rows.join(touched, same_key(("source", "id"), names), "left_semi")
    out = bridge.apply(exploded(rows, column), scope)
    fs, mark = bridge._fs(f"seen/{now.number}")
    fs.create(mark, True).close()
    return out


def tags(bridge: SnapshotTable) -> DataFrame:
    """source, id, technique of all tags, as ``coverage.bridge`` has them."""
    return bridge.read().select("source", "id", "technique")


def with_techniques(bridge: SnapshotTable, techniques: Sequence[str]) -> DataFrame:
    """source, id of the rules with one of the techniques, ignoring case; only files that may hold them are read."""
    return bridge.where_in("folded", [t.lower() for t in techniques]).select("source", "id").distinct()
