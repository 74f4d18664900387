"""Contexts along the paths of trees against a plain fold."""

from __future__ import annotations

import random

import pytest

from ledgerloom.operators import folds

SCHEMA = "file string, place long, id string, parent string, kind string, at string, model string, msg long, tool long, reas long, kept string, hooked boolean"


def plain(rows: list[dict]) -> list[tuple]:
    """What each entry of one file is judged by, folded in the order of the entries."""
    nothing = (0, 0, 0)

    def add(base, r):
        return base[0] + r["msg"], base[1] + r["tool"], (0 if r["kind"] == "user" else base[2]) + r["reas"]

    after, parent, model, added, out, last = {}, {}, {}, {}, [], nothing
    for r in sorted(rows, key=lambda r: r["place"]):
        base = after.get(r["parent"], nothing) if r["parent"] is not None else nothing if r["id"] is not None else last
        active, at = r["model"], r["parent"]
        while active is None and at is not None:
            active, at = model.get(at), parent.get(at)
        hooked = bool(r["hooked"]) and r["kind"] == "compaction"
        out.append((r["file"], r["id"], r["at"], None if hooked or r["kind"] == "tool" else active, *(nothing if hooked else base), hooked))
        if r["kind"] == "compaction":
            chain, at = [], r["parent"]
            while at is not None and at in added and (not chain or chain[-1] != r["kept"]):
                chain.append(at)
                at = parent.get(at)
            last = nothing
            for one in reversed(chain if chain and chain[-1] == r["kept"] else []):
                last = add(last, added[one])
            last, entry = (last[0] + r["msg"], *last[1:]), r | {"msg": 0, "tool": 0, "reas": 0, "kind": "none"}
        else:
            last, entry = add(base, r), r
        if r["id"] is not None:
            after[r["id"]], parent[r["id"]], added[r["id"]] = last, r["parent"], entry
            if r["model"] is not None:
                model[r["id"]] = r["model"]
    return out


def entries(rng: random.Random, file: str, n: int, bushy: float, nameless: float = 0.0) -> list[dict]:
    out, ids = [], []
    for place in range(n):
        kind = rng.choice(["user", "assistant", "assistant", "tool", "model", "compaction"])
        up = None if not ids or rng.random() < 0.02 else "missing" if rng.random() < 0.02 else rng.choice(ids) if rng.random() < bushy else ids[-1]
        ident = None if rng.random() < nameless else f"e{place}"
        kept = (rng.choice(ids) if ids and rng.random() < 0.8 else rng.choice([None, "missing"])) if kind == "compaction" else None
        out.append({"file": file, "place": place * 3, "id": ident, "parent": None if ident is None and rng.random() < 0.7 else up, "kind": kind, "at": f"t{place}", "model": rng.choice([None, None, "a", "b"]), "msg": rng.randrange(50), "tool": rng.randrange(9), "reas": rng.randrange(30), "kept": kept, "hooked": rng.choice([None, False, False, True])})
        if ident is not None:
            ids.append(ident)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees(spark, seed):
    rng = random.Random(seed)
    files = [entries(rng, f"f{i}", n, bushy, nameless) for i, (n, bushy, nameless) in enumerate([(1, 0, 0), (70, 0.02, 0), (90, 0.1, 0.1), (60, 0.9, 0)])]
    rows = [r for f in files for r in f]
    for r in rows:
        if r["kind"] == "compaction" and rng.random() < 0.5 and r["parent"] not in (None, "missing"):  # kept entries that lie on the path
            by, at = {x["id"]: x for x in rows if x["file"] == r["file"] and x["id"] is not None}, r["parent"]
            for _ in range(rng.randrange(12)):
                at = by[at]["parent"] if by.get(at, {}).get("parent") in by else at
            r["kept"] = at
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    got = folds.tree_contexts(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(x) for f in files for x in plain(f))


def test_no_entries_and_no_python(spark):
    none = folds.tree_contexts(spark.createDataFrame([], SCHEMA))
    assert none.collect() == []
    plan = none._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_a_deep_tree_takes_few_rounds(spark):
    from pyspark.sql import functions as F

    n = 20_000
    rows = spark.range(n).select(
        F.lit("f").alias("file"), F.col("id").alias("place"), F.concat(F.lit("e"), "id").alias("id_"), F.when(F.col("id") > 0, F.concat(F.lit("e"), F.col("id") - 1)).alias("parent"), F.when(F.col("id") % 1000 == 0, "user").otherwise("assistant").alias("kind"),
        F.lit("t").alias("at"), F.when(F.col("id") == 5, "m").alias("model"), F.lit(1).cast("long").alias("msg"), F.lit(0).cast("long").alias("tool"), F.lit(2).cast("long").alias("reas"), F.lit(None).cast("string").alias("kept"), F.lit(False).alias("hooked"),
    ).withColumnRenamed("id_", "id")
    got = folds.tree_contexts(rows).orderBy(F.expr("cast(substring(id, 2) as int)")).collect()
    assert [r.msg for r in got] == list(range(n)) and got[-1].model == "m" and got[4].model is None
    assert [r.reas for r in got[999:1003]] == [1998, 2000, 2, 4]
