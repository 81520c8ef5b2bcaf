"""Solver progress as a stream of packets: framing, classifying, folding, debouncing, writing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What marks an incumbent's line, and what lines of a log say, by the first pattern that matches.
PREFIX = "INCUMBENT_JSON:"
INCUMBENT = "bb_node long, lambda double, param_obj double, density double, size long, nodes array<string>"
LINE_CLASSES = [
    ("header", r"^={10,}"), ("separator", r"^-{10,}"), ("warn", r"\[!\]"), ("incumbent", r"Incumbent updated"), ("iteration", r"DINKELBACH ITERATION"),
    ("prune", r"Pruning|Pruned node"), ("success", r"Converged|FINAL SOLUTION|Graph built|Solved\."), ("error", r"(?i)Error|Exception|Fatal|Blacklisting"),
]
STAMP = r"^\[[\d\- :,]+\]\s*"
#: The log lines that solvers print, as patterns in the order they are tried, and the fields that their groups set (the type tells how a group is read).
TELEMETRY = [
    (r"=== DINKELBACH ITERATION (\d+) \| Lambda = ([\d.eE+-]+) ===", {"iteration": int, "lambda": float}),
    (r"Init Active Set\s*\|\s*Size:\s*(\d+)\s*\|\s*Density:\s*([\d.eE+-]+)", {"size": int, "lambda": float}),
    (r"->\s*Nodes Explored\s*:\s*\d+\s*\(Total:\s*(\d+)\)", {"bb_nodes": int}),
    (r"->\s*LP Solves\s*:\s*\d+\s*\(Total:\s*(\d+)\)", {"lp_solves": int}),
    (r"Incumbent updated at Node \d+\s*\|\s*Obj:\s*([\d.eE+-]+)\s*\|\s*Size:\s*(\d+)", {"incumbent_obj": float, "incumbent_size": int}),
    (r"Found Solution\s*:\s*Size:\s*(\d+)\s*\|\s*New Density:\s*([\d.eE+-]+)", {"size": int, "lambda": float}),
    (r"Status\s*:\s*Converged", {}),
    (r"Blacklisting node (\S+?)(?:\s+(?:during|due to)\s+([^:]+?))?\s*:\s*(.+)$", {}),
    (r"^B&B Nodes Explored\s+:\s*(\d+)", {"bb_nodes": int}),
    (r"^Total LP Solves\s+:\s*(\d+)", {"lp_solves": int}),
    (r"^Columns Generated\s+:\s*(\d+)", {"columns_generated": int}),
    (r"^BQP Cuts Added\s+:\s*(\d+)", {"cuts_added": int}),
    (r"^Total Solver Time\s+:\s*([\d.]+)s", {"solver_time": float}),
    (r"^Density\s+:\s*([\d.eE+-]+)", {"density": float}),
    (r"^Size\s+:\s*(\d+)", {"size": int}),
]
FIELDS = {"iteration": "int", "lambda": "double", "bb_nodes": "long", "lp_solves": "long", "incumbent_obj": "double", "incumbent_size": "long", "size": "long", "columns_generated": "long", "cuts_added": "long", "solver_time": "double", "density": "double"}
_DONE, _BARRED = 6, 7  # the two patterns that set no field
DEBOUNCE_MS = 350


def packets(lines: DataFrame, value: str = "value") -> DataFrame:
    """Each line as a packet: ``incumbent`` if it has the prefix and valid JSON after it, else ``log``. Works on streams."""
    body = F.expr(f"substring({value}, {len(PREFIX) + 1})")
    ok = F.col(value).startswith(PREFIX) & F.try_parse_json(body).isNotNull()
    return lines.withColumns({"type": F.when(ok, "incumbent").otherwise("log"), "content": F.when(ok, body).otherwise(F.rtrim(value))})


def strip_stamp(c: Column) -> Column:
    return F.regexp_replace(c, STAMP, "")


def classify_line(c: Column) -> Column:
    """What a line is about, for showing it: one of nine classes."""
    clean = strip_stamp(c)
    out = F.when(clean.rlike(LINE_CLASSES[0][1]), LINE_CLASSES[0][0])
    for name, pattern in LINE_CLASSES[1:]:
        out = out.when(clean.rlike(pattern), name)
    return out.otherwise("info")


def fold_incumbents(packet: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """Per session: the most nodes seen, and the last incumbent's density and size. Works on streams (complete or update mode)."""
    p = F.from_json("content", INCUMBENT)
    return packet.where("type = 'incumbent'").withColumn("p", p).groupBy(session).agg(
        F.max("p.bb_node").alias("bb_nodes"), F.max_by("p.density", seq).alias("density"), F.max_by("p.size", seq).alias("size"), F.count("*").alias("incumbents"),
    )


def telemetry_updates(packet: DataFrame) -> DataFrame:
    """What each packet sets: ``session, seq, pattern`` and the fields, null where it sets none. JVM-side; works on streams.

    ``pattern`` numbers the telemetry patterns from 0; -1 is an incumbent packet; packets that set nothing are left out.
    """
    clean = strip_stamp(F.col("content"))
    hit = F.when(F.col("type") == "incumbent", F.lit(-1))
    for i, (pattern, _) in enumerate(TELEMETRY):
        hit = hit.when(clean.rlike(pattern), F.lit(i))
    # Exploded, so that each line is matched once: a plain projection would be put into every field's expression.
    matched = F.struct(clean.alias("_line"), hit.alias("pattern"), F.when(F.col("type") == "incumbent", F.from_json("content", INCUMBENT)).alias("_inc"))
    df = packet.select("session", "seq", F.explode(F.array(matched)).alias("_m")).select("session", "seq", "_m.*").where("pattern IS NOT NULL")
    own = {"lambda": "_inc.lambda", "bb_nodes": "_inc.bb_node", "size": "_inc.size", "incumbent_obj": "_inc.param_obj", "incumbent_size": "_inc.size"}
    out = {}
    for name, kind in FIELDS.items():
        c = F.when(F.col("pattern") == -1, F.col(own[name]).cast(kind)) if name in own else None
        for i, (pattern, sets) in enumerate(TELEMETRY):
            if name in sets:
                got = F.regexp_extract("_line", pattern, list(sets).index(name) + 1).try_cast(kind)
                c = F.when(F.col("pattern") == i, got) if c is None else c.when(F.col("pattern") == i, got)
        out[name] = c
    barred = [F.regexp_extract("_line", TELEMETRY[_BARRED][0], g) for g in (1, 2, 3)]
    entry = F.when(F.col("pattern") == _BARRED, F.struct(barred[0].alias("id"), F.nullif(F.trim(barred[1]), F.lit("")).alias("phase"), F.trim(barred[2]).alias("reason")))
    return df.select("session", "seq", "pattern", *(c.alias(n) for n, c in out.items()), entry.alias("blacklisted"))


def telemetry_snapshot(packet: DataFrame) -> DataFrame:
    """The last snapshot of each session, in batch: every field's last value, whether it converged, and nodes barred (the first report of each).

    An incumbent packet never lowers the number of nodes: it counts from the last log line that set it.
    """
    u = telemetry_updates(packet)
    last = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq")))
    set_at = u.where("pattern >= 0 AND bb_nodes IS NOT NULL").groupBy("session").agg(F.max("seq").alias("_set"))
    u = u.join(set_at, "session", "left")
    counts = F.max(F.when((F.col("pattern") == -1) & (F.col("seq") > F.coalesce("_set", F.lit(-1))) | (F.col("seq") == F.col("_set")), F.col("bb_nodes")))
    done = F.max((F.col("pattern") == _DONE).cast("int")) > 0
    first = u.where("blacklisted IS NOT NULL").groupBy("session", "blacklisted.id").agg(F.min(F.struct("seq", "blacklisted")).alias("b")).groupBy("session").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b.blacklisted).alias("blacklisted"))
    fields = [(F.coalesce(counts, F.lit(0)) if n == "bb_nodes" else F.coalesce(last(n), F.lit(0)) if n == "lp_solves" else last(n)).alias(n) for n in FIELDS]
    return u.groupBy("session").agg(*fields, F.when(done, "converged").otherwise("running").alias("status")).join(first, "session", "left")


def fold_line(state: dict, line: str) -> dict:
    """A snapshot after one more log line; the same object where the line says nothing."""
    clean = re.sub(STAMP, "", line)
    for i, (pattern, sets) in enumerate(TELEMETRY):
        if m := re.search(pattern, clean):
            if i == _DONE:
                return state | {"status": "converged"}
            if i == _BARRED:
                known = state.get("blacklisted", [])
                if any(e["id"] == m[1] for e in known):
                    return state
                return state | {"blacklisted": [*known, {"id": m[1], "phase": (m[2] or "").strip() or None, "reason": m[3].strip()}]}
            return state | {name: kind(m[g + 1]) for g, (name, kind) in enumerate(sets.items())}
    return state


def fold_packet(state: dict, kind: str, content: dict | str) -> dict:
    """A snapshot after one more packet."""
    if kind == "log":
        return fold_line(state, content)
    if kind == "incumbent":
        number = lambda k: content[k] if isinstance(content.get(k), (int, float)) else None
        out = {"incumbent_obj": number("param_obj"), "incumbent_size": number("size")}
        out |= {k: number(k) for k in ("lambda", "size") if number(k) is not None}
        return state | out | ({"bb_nodes": max(state.get("bb_nodes") or 0, number("bb_node"))} if number("bb_node") is not None else {})
    return state | ({"status": "error"} if kind == "error" else {})


def fold_telemetry(packet: DataFrame) -> DataFrame:
    """Stateful fold of a stream of ``session, seq, type, content``: a snapshot per session whenever packets come.

    Within a batch packets are folded by ``seq``; a packet that comes after a later one is folded when it comes.
    """
    import json

    import pandas as pd

    names = list(FIELDS)

    def fold(key, frames, state):
        kept, seq = state.get if state.exists else ("{}", -1)
        snapshot = json.loads(kept)
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            content = json.loads(row.content) if row.type == "incumbent" else row.content
            snapshot, seq = fold_packet(snapshot, row.type, content), max(seq, int(row.seq))
        state.update((json.dumps(snapshot), seq))
        row = {"session": key[0], "seq": seq, "status": snapshot.get("status", "running"), "blacklisted": [e["id"] for e in snapshot.get("blacklisted", [])]} | {n: snapshot.get(n) for n in names}
        yield pd.DataFrame([row]).astype({n: "Int64" if k in ("int", "long") else "Float64" for n, k in FIELDS.items()})

    fields = ", ".join(f"`{n}` {k}" for n, k in FIELDS.items())
    return packet.groupBy("session").applyInPandasWithState(fold, f"session string, seq long, status string, blacklisted array<string>, {fields}", "snapshot string, seq long", "update", "NoTimeout")


def distinct_incumbents(packet: DataFrame) -> DataFrame:
    """``session, seq, signature, nodes`` of incumbents whose nodes differ from those of the incumbent before; ones without nodes are passed over."""
    from pyspark.sql import Window

    p = F.from_json("content", INCUMBENT)
    rows = packet.where("type = 'incumbent'").select("session", "seq", *(c for c in ("at_ms",) if c in packet.columns), p.nodes.alias("nodes")).where(F.size("nodes") > 0).withColumn("signature", F.array_join("nodes", "|"))
    before = F.lag("signature").over(Window.partitionBy("session").orderBy("seq"))
    return rows.withColumn("_b", before).where(~F.col("signature").eqNullSafe(F.col("_b"))).drop("_b")


def debounced_incumbents(packet: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Of the distinct incumbents (with a time ``at_ms``) those that none follows within ``quiet_ms``: the ones worth drawing."""
    from pyspark.sql import Window

    rows = distinct_incumbents(packet)
    after = F.lead("at_ms").over(Window.partitionBy("session").orderBy("seq"))
    return rows.withColumn("_a", after).where(F.col("_a").isNull() | (F.col("_a") - F.col("at_ms") >= quiet_ms)).drop("_a")


def debounce_stream(packet: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """The same on a stream, by processing time: a session's latest node set comes out once the stream has been quiet for it."""
    import json

    import pandas as pd

    def wait(key, frames, state):
        shown, held = state.get if state.exists else ("", "")
        if state.hasTimedOut:
            state.update((shown, ""))
            if held:
                yield pd.DataFrame([{"session": key[0], "signature": held}])
            return
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            nodes = json.loads(row.content).get("nodes") if row.type == "incumbent" else None
            signature = "|".join(map(str, nodes)) if nodes else ""
            if signature and signature != shown:
                shown = held = signature
        state.update((shown, held))
        if held:
            state.setTimeoutDuration(quiet_ms)

    return packet.groupBy("session").applyInPandasWithState(wait, "session string, signature string", "shown string, held string", "append", "ProcessingTimeTimeout")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A folder of log files as a stream of lines."""
    return spark.readStream.text(path)


def packet_json(packet: DataFrame) -> DataFrame:
    """Packets as lines of JSON: an incumbent's content is the object itself, a log's is text."""
    log = F.to_json(F.struct(F.lit("log").alias("type"), F.col("content")))
    return packet.select(F.when(F.col("type") == "incumbent", F.concat(F.lit('{"type":"incumbent","content":'), "content", F.lit("}"))).otherwise(log).alias("value"))


def write_packets(packet: DataFrame, path: str, checkpoint: str):
    """A stream of packets as files of JSON lines; the running query."""
    return packet_json(packet).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
