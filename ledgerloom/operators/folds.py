"""How each call's billed context divides into messages, system prompt and reasoning, from what a transcript logged before it.

A transcript's composition is a running sum: content adds to messages (tool calls, servers and skills are parts of it),
thinking to reasoning until the user's next turn, and a compaction starts the content anew. So the fold is window sums over
one session of one file, in the order of its lines: nothing is carried row by row. Sizes are estimates, a token for four bytes.
Trees, whose context is what lies on an entry's own path, are folded by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.functions.formats import SKILL_BODY, estimate, iso_epoch, skill_name
from ledgerloom.session import cut

PARTS = ("msg", "tool", "mcp", "skill", "reas")
_BLOCK = "array<struct<type: string, text: string, thinking: string, id: string, name: string, input: string, content: string, tool_use_id: string>>"
_LINE = "type string, subtype string, sessionId string, timestamp string, isSidechain boolean, message struct<id: string, content: string>"


def size_of(value: Column) -> Column:
    """Tokens of a content value: a string's bytes or its JSON's; a missing one counts as JSON's null."""
    return estimate(F.octet_length(F.coalesce(value, F.lit("null"))))


def session_of(j: Column) -> Column:
    return F.coalesce(j["sessionId"], F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1))


def with_blocks(lines: DataFrame) -> DataFrame:
    """Adds l, the line of a transcript, and b, its content blocks; a string is one block of kind string. Lines of other kinds have
    none."""
    parsed = lines.select("*", F.from_json("line", _LINE).alias("l"), F.try_parse_json("line").alias("v"))
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant")) == "STRING", F.lit(False))
    one = F.array(F.struct(F.lit("string").alias("type"), F.col("l.message.content").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("thinking", "id", "name", "input", "content", "tool_use_id")]))
    each = F.when(is_text, F.when(F.col("l.type") == "user", one)).otherwise(F.from_json("l.message.content", _BLOCK))
    return parsed.withColumn("b", F.when(F.col("l.type").isin("user", "assistant"), each)).drop("v")


def block_body(b: Column) -> Column:
    kind = b["type"]
    return F.when(kind == "thinking", b["thinking"]).when(kind == "tool_use", b["input"]).when(kind == "tool_result", b["content"]).otherwise(b["text"])


def block_id(b: Column) -> Column:
    return F.when(b["type"] == "tool_use", b["id"]).when(b["type"] == "tool_result", b["tool_use_id"])


def blocks(lines: DataFrame) -> DataFrame:
    """lines(file, place, line) -> (file, place, session, type, at, n, kind, name, server, id, body): one row for each content
    block of user and assistant lines."""
    rows = with_blocks(lines.select("file", "place", "line")).filter("l.type in ('user', 'assistant')")
    rows = rows.select("file", "place", session_of(F.col("l")).alias("session"), F.col("l.type").alias("type"), F.coalesce(iso_epoch(F.col("l.timestamp")), F.lit(0)).alias("at"), F.posexplode("b").alias("n", "b"))
    body = block_body(F.col("b"))
    return rows.select("file", "place", "session", "type", "at", "n", F.col("b.type").alias("kind"), F.col("b.name").alias("name"), block_id(F.col("b")).alias("id"), body.alias("body"), size_of(body).alias("size"))


def named_blocks(found: DataFrame) -> DataFrame:
    """Blocks where a tool's result carries the name of its call, found by the call's id in the same file, before it."""
    calls = found.filter("kind = 'tool_use' and id is not null").groupBy("file", "id").agg(F.min_by("name", "place").alias("called"), F.min("place").alias("since"))
    calls = calls.select(F.col("file").alias("f"), F.col("id").alias("i"), "called", "since")
    rows = found.join(calls, (F.col("kind") == "tool_result") & (F.col("file") == F.col("f")) & (F.col("id") == F.col("i")) & (F.col("since") < F.col("place")), "left")
    name = F.when(F.col("kind") == "tool_result", F.coalesce("called", F.lit("unknown"))).when(F.col("kind") == "tool_use", F.coalesce("name", F.lit("")))
    return rows.withColumn("name", name).drop("f", "i", "called", "since")


def line_sums(named: DataFrame) -> DataFrame:
    """(file, session, place, PARTS, turns): what each line adds; turns: whether it is a turn of the user's."""
    user, said = F.col("type") == "user", F.col("kind").isin("string", "text")
    tool = (user & (F.col("kind") == "tool_result")) | (~user & (F.col("kind") == "tool_use"))
    loads = user & (F.col("kind") == "text") & skill_name(F.col("body")).isNotNull()
    amount = lambda ok: F.sum(F.when(ok, F.col("size")).otherwise(0))
    return named.groupBy("file", "session", "place").agg(
        amount(said | tool).alias("msg"), amount(tool).alias("tool"), amount(tool & F.col("name").startswith("mcp__")).alias("mcp"), amount((tool & (F.col("name") == "Skill")) | loads).alias("skill"),
        amount(~user & (F.col("kind") == "thinking")).alias("reas"), F.max(F.when(user & said, 1).otherwise(0)).alias("turns"),
    )


def compositions(lines: DataFrame, calls: DataFrame, prior: DataFrame | None = None, resumed: bool = False) -> DataFrame:
    """lines(file, place, line) and calls(file, session, place, billed), one row for each billed line -> calls with PARTS, sys
    and tainted: the composition before the line. prior(file, session, PARTS, sys) is the state that an earlier read of the
    file ended with; a session of a file that is read on (`resumed`) without one is tainted, its parts are not known."""
    marks = lines.select("file", "place", F.from_json("line", "type string, subtype string, sessionId string").alias("j")).filter("j.type = 'system' and j.subtype = 'compact_boundary'")
    marks = marks.select("file", F.coalesce("j.sessionId", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("session"), "place", F.lit(1).alias("cut"))
    sums = line_sums(named_blocks(blocks(lines)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = sums.join(calls.select("file", "session", "place", "billed"), ["file", "session", "place"], "full").join(marks, ["file", "session", "place"], "full")
    rows = rows.select("file", "session", F.lit(1).alias("part"), "place", *map(zero, PARTS), zero("turns"), zero("cut"), "billed", F.lit(None).cast("long").alias("known_sys"))
    if prior is not None:
        first = rows.schema["place"].dataType
        rows = rows.unionByName(prior.select("file", "session", F.lit(0).alias("part"), F.lit(None).cast(first).alias("place"), *PARTS, F.lit(0).cast("long").alias("turns"), F.lit(0).cast("long").alias("cut"), F.lit(None).cast("long").alias("billed"), F.col("sys").alias("known_sys")))
    one = W.Window.partitionBy("file", "session").orderBy("part", "place")
    rows = rows.withColumn("epoch", F.sum("cut").over(one)).withColumn("turn", F.sum("turns").over(one))
    content = W.Window.partitionBy("file", "session", "epoch").orderBy("part", "place").rowsBetween(W.Window.unboundedPreceding, -1)
    thought = W.Window.partitionBy("file", "session", "epoch", "turn").orderBy("part", "place").rowsBetween(W.Window.unboundedPreceding, -1)
    before = {p: F.coalesce(F.sum(p).over(thought if p == "reas" else content), F.lit(0)) for p in PARTS}
    rows = rows.select("file", "session", "place", "part", "billed", "known_sys", *[before[p].alias(p) for p in PARTS], F.max("part").over(W.Window.partitionBy("file", "session")).alias("last"), F.min("part").over(W.Window.partitionBy("file", "session")).alias("least"))
    found = F.when(F.col("billed").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("billed") - F.col("msg") - F.col("reas")))
    sys = F.first(F.coalesce("known_sys", found), ignorenulls=True).over(one.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    tainted = (F.lit(resumed) & (F.col("least") == 1)).alias("tainted")
    return rows.withColumn("sys", F.coalesce(sys, F.lit(0))).filter("billed is not null").select("file", "session", "place", "billed", *PARTS, "sys", tainted)


def final_state(lines: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, session, PARTS, sys): the compositions at the end of the files, for reading on later: `compositions` of one more
    line behind all others."""
    after = lines.groupBy("file").agg(F.max("place").alias("last"))
    ends = blocks(lines).select("file", "session").distinct().join(after, "file").select("file", "session", (F.col("last") + 1).alias("place"), F.lit(0).cast("long").alias("billed"))
    state = compositions(lines, calls.select("file", "session", "place", "billed").unionByName(ends))
    return state.join(ends.select("file", "session", "place"), ["file", "session", "place"], "left_semi").select("file", "session", *PARTS, "sys")


def attributed(rows: DataFrame, observed: tuple[str, ...] = ("system", "mcp", "skills"), sidechain: Column | None = None) -> DataFrame:
    """rows(billed, PARTS, sys, tainted) -> with the ctx_ columns: exact shares of what was billed, messages taking the rest.
    All are null where nothing was logged before; a share of reasoning of zero is not known. observed: which of system, mcp
    and skills this kind of log can show at all; agents is what a side chain was billed."""
    total = F.col("msg") + F.col("reas") + F.col("sys")
    known = (total > 0) & ~F.col("tainted")
    rows = rows.withColumn("__total", total)
    share = lambda part: F.expr(f"billed * {part} div if(__total > 0, __total, 1)")
    messages = F.col("billed") - share("sys") - share("reas")
    within = lambda part: F.least(share(part), messages)
    made = {"messages": messages, "system": share("sys"), "reasoning": F.nullif(share("reas"), F.lit(0)), "toolcalls": within("tool"), "mcp": within("mcp"), "skills": within("skill")}
    hidden = {"system", "mcp", "skills"} - set(observed)
    out = rows.select("*", *[F.when(known & F.lit(n not in hidden), c).cast("long").alias(f"ctx_{n}") for n, c in made.items()], F.when(sidechain if sidechain is not None else F.lit(False), F.col("billed")).cast("long").alias("ctx_agents"))
    return out.drop("__total")


def call_contexts(lines: DataFrame, records: DataFrame, **how) -> DataFrame:
    """records(file, session, place, dedup_key, billed, sidechain): one row for each billed record of a line, in the order of
    `i` where a line has several -> with ctx_ columns. A key that is logged again is divided by what stood before its first
    line, but by its own billed tokens."""
    first = records.groupBy("file", "session", "place").agg(F.min_by("billed", "i").alias("billed"))
    comps = compositions(lines, first, **how).drop("billed")
    rows = records.join(comps, ["file", "session", "place"])
    by = W.Window.partitionBy("file", "dedup_key").orderBy("place", "i")
    kept = rows.select(*records.columns, *[F.first(c).over(by).alias(c) for c in (*PARTS, "sys", "tainted")])
    return attributed(kept, sidechain=F.col("file").contains("/subagents/") | F.coalesce("sidechain", F.lit(False)))


def resources_used(lines: DataFrame) -> DataFrame:
    """(kind, name, at): servers, skills, agents and memory files that calls name."""
    found = named_blocks(blocks(lines)).filter("kind = 'tool_use'")
    of = lambda path: F.get_json_object("body", path)
    memory = of("$.file_path").rlike(r"[/\\]memory[/\\].*MEMORY\.md$|[/\\]memory[/\\]MEMORY\.md$")
    kind = F.when(F.col("name").startswith("mcp__"), "mcp_server").when(F.col("name") == "Skill", "skill").when(F.col("name").isin("Task", "Agent"), "agent").when((F.col("name") == "Read") & memory, "memory_file")
    name = F.when(kind == "mcp_server", F.get(F.split("name", "__"), F.lit(1))).when(kind == "skill", of("$.skill")).when(kind == "agent", F.coalesce(of("$.subagent_type"), F.lit("agent"))).otherwise(of("$.file_path"))
    return found.select(kind.alias("kind"), name.alias("name"), "at").filter("kind is not null and name is not null")


def tool_rows(lines: DataFrame) -> DataFrame:
    """(file, name, at, est_tokens, calls): what tools' calls and results weigh."""
    found = named_blocks(blocks(lines)).filter("kind in ('tool_use', 'tool_result')")
    return found.groupBy("file", "name", "at").agg(F.sum("size").alias("est_tokens"), F.sum(F.when(F.col("kind") == "tool_use", 1).otherwise(0)).alias("calls"))


def skill_rows(lines: DataFrame) -> DataFrame:
    """(file, name, at, est_tokens, uses): skills that messages load, every copy counts."""
    found = blocks(lines).filter((F.col("type") == "user") & (F.col("kind") == "text") & F.col("body").startswith(SKILL_BODY)).withColumn("name", skill_name(F.col("body"))).filter("name is not null")
    return found.groupBy("file", "name", "at").agg(F.sum("size").alias("est_tokens"), F.count("*").alias("uses"))


def rollout_contexts(lines: DataFrame, records: DataFrame) -> DataFrame:
    """lines(file, place, line) of running-total logs and records(file, place, billed) at their totals -> records with ctx_
    columns; such logs can't show the system prompt, servers or skills."""
    rows = lines.select("file", "place", F.from_json("line", "type string, payload string").alias("j")).filter("j.type = 'response_item'")
    rows = rows.select("file", "place", F.from_json("j.payload", "type string, role string").alias("p"), estimate(F.octet_length("j.payload")).alias("size"))
    tool, said = F.col("p.type").isin("function_call", "function_call_output"), F.col("p.type") == "message"
    amount = lambda ok: F.when(ok, F.col("size")).otherwise(0).cast("long")
    items = rows.select("file", "place", amount(said | tool).alias("msg"), amount(tool).alias("tool"), amount(F.col("p.type") == "reasoning").alias("reas"), F.when(said & (F.col("p.role") == "user"), 1).otherwise(0).cast("long").alias("turns"), F.lit(None).cast("long").alias("billed"))
    none = F.lit(0).cast("long")
    both = items.unionByName(records.select("file", "place", none.alias("msg"), none.alias("tool"), none.alias("reas"), none.alias("turns"), "billed"))
    one = W.Window.partitionBy("file").orderBy("place")
    both = both.withColumn("turn", F.sum("turns").over(one))
    upto = one.rowsBetween(W.Window.unboundedPreceding, -1)
    in_turn = W.Window.partitionBy("file", "turn").orderBy("place").rowsBetween(W.Window.unboundedPreceding, -1)
    before = {"msg": upto, "tool": upto, "reas": in_turn}
    sums = both.select("file", "place", "billed", *[F.coalesce(F.sum(p).over(w), F.lit(0)).alias(p) for p, w in before.items()]).filter("billed is not null")
    none = F.lit(0).cast("long")
    return attributed(sums.withColumn("mcp", none).withColumn("skill", none).withColumn("sys", none).withColumn("tainted", F.col("billed") <= 0), observed=())


def tree_contexts(entries: DataFrame) -> DataFrame:
    """entries(file, place, id, parent, kind, at, model, msg, tool, reas, kept, hooked) of tree logs, kind one of user, assistant,
    tool, model and compaction, the parts what an entry adds -> (file, id, at, model, msg, tool, reas, hooked) for each entry: the
    model in force on its path and the composition before it. A user's entry clears the reasoning; below a compaction stand its
    summary and the entries from `kept` on; an entry without id follows the entry before it. A parent is the last entry before with
    that id.

    Everything is a sum or the nearest of something along the path to the root, so paths are folded by pointer doubling: in each
    round, an entry takes over what the entry at its pointer has folded, and that entry's pointer. A file of any shape takes the
    logarithm of its depth in rounds, and no file is gathered anywhere."""
    rows = _linked(entries)
    paths, jumps = _doubled(rows)
    after = _after(rows, paths, jumps)
    below = after.select("file", F.col("node").alias("up"), *[F.col(c).alias(f"b_{c}") for c in ("msg", "tool", "reas")])
    out = rows.join(paths.select("file", "node", "active"), ["file", "node"]).join(below, ["file", "up"], "left")
    hooked = (F.col("kind") == "compaction") & F.coalesce("hooked", F.lit(False))
    part = lambda c: F.when(hooked, 0).otherwise(F.coalesce(f"b_{c}", F.lit(0))).cast("long").alias(c)
    active = F.when(~hooked & (F.col("kind") != "tool"), F.when(F.col("follows"), F.col("model")).otherwise(F.col("active")))
    return out.select("file", "id", "at", active.alias("model"), part("msg"), part("tool"), part("reas"), hooked.alias("hooked"))


def _linked(entries: DataFrame) -> DataFrame:
    """Entries with node (their place), up (the place of the entry they hang on), from (that of the kept one) and follows."""
    rows = entries.withColumn("node", F.col("place")).withColumn("follows", F.col("id").isNull() & F.col("parent").isNull())
    ask = lambda ref, what: rows.filter(F.col(ref).isNotNull()).select("file", F.col(ref).alias("ref"), "place", F.lit(what).alias("what"))
    named = ask("id", 2).unionByName(ask("parent", 0)).unionByName(ask("kept", 1))
    before = W.Window.partitionBy("file", "ref").orderBy("place", "what").rowsBetween(W.Window.unboundedPreceding, -1)
    found = named.withColumn("to", F.last(F.when(F.col("what") == 2, F.col("place")), ignorenulls=True).over(before)).filter("what < 2")
    links = found.groupBy("file", F.col("place").alias("node")).agg(F.max(F.when(F.col("what") == 0, F.col("to"))).alias("up"), F.max(F.when(F.col("what") == 1, F.col("to"))).alias("from"))
    rows = rows.join(links, ["file", "node"], "left")
    if not rows.filter("follows").isEmpty():  # logs without such entries need no order within their files
        rows = rows.withColumn("up", F.when(F.col("follows"), F.lag("node").over(W.Window.partitionBy("file").orderBy("place"))).otherwise(F.col("up")))
    return cut(rows)


def _doubled(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(paths, jumps). paths(file, node, msg, tool, reas, depth, active, said, since, cutter): sums over the path, its model, the
    reasoning down from the nearest user's entry with how many entries below that this is, and the nearest compaction. jumps[k](file,
    node, to): the 2^k-th entry up."""
    adds = lambda c: F.when(F.col("kind") == "compaction", 0).otherwise(F.col(c)).cast("long").alias(c)
    user = F.col("kind") == "user"
    state = cut(rows.select(
        "file", "node", F.col("up").alias("to"), adds("msg"), adds("tool"), adds("reas"), F.lit(1).cast("long").alias("depth"), F.col("model").alias("active"), F.when(user, F.col("reas")).cast("long").alias("said"),
        F.when(user, 0).cast("long").alias("since"), F.when(F.col("kind") == "compaction", F.col("node")).alias("cutter"),
    ))
    done, jumps, names = None, [], state.columns
    while True:
        closed = state.filter(F.col("to").isNull())
        done = closed if done is None else done.unionByName(closed)
        going = state.filter(F.col("to").isNotNull())
        jumps.append(going.select("file", "node", "to"))
        if going.isEmpty():
            return cut(done.drop("to")), jumps
        there = done.unionByName(going).select([F.col(c).alias(c if c == "file" else f"u_{c}") for c in names])
        both = going.join(there.withColumnRenamed("u_node", "to_"), (going.file == there.file) & (F.col("to") == F.col("to_"))).drop(there.file)
        state = cut(both.select(
            "file", "node", F.col("u_to").alias("to"), *[(F.col(c) + F.col(f"u_{c}")).alias(c) for c in ("msg", "tool", "reas", "depth")], F.coalesce("active", "u_active").alias("active"),
            F.coalesce("said", F.col("reas") + F.col("u_said")).alias("said"), F.coalesce("since", F.col("depth") + F.col("u_since")).alias("since"), F.coalesce("cutter", "u_cutter").alias("cutter"),
        ))
        done = cut(done)


def _after(rows: DataFrame, paths: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(file, node, msg, tool, reas): the composition behind each entry."""
    at = lambda prefix, key: paths.select("file", F.col("node").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in ("msg", "tool", "reas", "depth", "said", "since")])
    cuts = rows.filter("kind = 'compaction'").select("file", "node", "up", "from", F.col("msg").alias("summary"))
    cuts = cuts.join(at("p", "up"), ["file", "up"], "left").join(at("k", "from"), ["file", "from"], "left")
    kept = rows.select("file", F.col("node").alias("from"), *[F.when(F.col("kind") == "compaction", 0).otherwise(F.col(c)).alias(f"own_{c}") for c in ("msg", "tool", "reas")])
    cuts = cuts.join(kept, ["file", "from"], "left").withColumn("far", F.col("p_depth") - F.col("k_depth")).withColumn("here", F.col("up"))
    if not cuts.filter("far >= 0").isEmpty():
        for k, jump in enumerate(jumps):  # the entry that lies `far` above the parent
            step = jump.select("file", F.col("node").alias("here"), F.col("to").alias("there"))
            cuts = cuts.join(step, ["file", "here"], "left").withColumn("here", F.when(F.expr(f"far >= 0 and (far & {1 << k}) <> 0"), F.col("there")).otherwise(F.col("here"))).drop("there")
    on_path = F.coalesce((F.col("far") >= 0) & (F.col("here") == F.col("from")), F.lit(False))
    span = lambda c: F.when(on_path, F.col(f"p_{c}") - F.col(f"k_{c}") + F.col(f"own_{c}")).otherwise(0)
    thought = F.when(on_path & F.coalesce(F.col("p_since") <= F.col("far"), F.lit(False)), F.col("p_said")).otherwise(span("reas"))
    cuts = cuts.select("file", F.col("node").alias("cutter"), (span("msg") + F.col("summary")).alias("c_msg"), span("tool").alias("c_tool"), thought.alias("c_reas"))
    whole = paths.select("file", F.col("node").alias("cutter"), *[F.col(c).alias(f"w_{c}") for c in ("msg", "tool", "reas", "depth")])
    every = paths.join(cut(cuts.join(whole, ["file", "cutter"])), ["file", "cutter"], "left")
    beyond = lambda c: F.when(F.col("cutter").isNull(), F.col(c)).otherwise(F.col(c) - F.col(f"w_{c}") + F.col(f"c_{c}"))
    fresh = F.coalesce(F.col("since") < F.col("depth") - F.coalesce("w_depth", F.lit(0)), F.lit(False))
    return every.select("file", "node", beyond("msg").alias("msg"), beyond("tool").alias("tool"), F.when(fresh, F.col("said")).otherwise(beyond("reas")).alias("reas"))


def owned(rows: DataFrame) -> DataFrame:
    """rows(ident, file, ..): of entries that copies of a file repeat, those of the file that has them first, by name; entries
    without an identity all stay."""
    # Rows are read and shuffled once; those without an identity are dealt out by all they hold. An identity has a row for each copy.
    one = rows.withColumn("alone", F.when(F.col("ident").isNull(), F.xxhash64(*rows.columns)))
    owner = F.when(F.col("ident").isNotNull(), F.min("file").over(W.Window.partitionBy("ident", "alone")))
    return one.withColumn("owner", owner).filter("owner is null or owner = file").drop("owner", "alone")
