"""Who works on what: counts, days, recency, naming, and the union of facts behind a path query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import HALF_LIFE, decay


def _once(**columns):
    """A generator of one row: a filter on these columns reads them, where else it would make them anew for each mention."""
    return F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))


def recency(days: DataFrame, today: int, by: list[str], half_life: float = HALF_LIFE) -> DataFrame:
    """Sum of half-life weights over the distinct days of each group."""
    distinct = days.select(*by, "day").where("day IS NOT NULL").distinct()
    return distinct.groupBy(*by).agg(F.sum(decay(F.col("day"), F.lit(today), half_life)).alias("weight"), F.count("*").alias("days"))


def reads_writes(calls: DataFrame) -> DataFrame:
    """Completed tool calls by agent and project of the call's own path."""
    done = calls.where(F.col("verdict") == "ok")
    return done.groupBy("agent", "project").agg(F.count_if(F.col("role") == "read").alias("reads"), F.count_if(F.col("role") == "write").alias("writes"))


def shell_uses(uses: DataFrame) -> DataFrame:
    """Uses (agent, path, write, verdict, reached) to four counters by admission; rejected calls don't count."""
    from .outcomes import admits

    ok = admits(F.col("verdict"), F.col("reached"))
    use = uses.where(F.col("verdict") != "rejected").withColumn("_sure", ok)
    w = F.col("write")
    return use.groupBy("agent", "path").agg(
        F.count_if(~w & F.col("_sure")).alias("reads"), F.count_if(w & F.col("_sure")).alias("edits"),
        F.count_if(~w & ~F.col("_sure")).alias("maybe_reads"), F.count_if(w & ~F.col("_sure")).alias("maybe_edits"),
    )


def remote_uses(uses: DataFrame) -> DataFrame:
    """Remote uses by host and path, whatever their reach; rejected calls and scratch paths don't count."""
    from ..functions.paths import remotely_attributable

    ok = uses.where((F.col("verdict") != "rejected") & remotely_attributable(F.col("path")))
    return ok.groupBy("agent", "host", "path").agg(F.count_if(~F.col("write")).alias("reads"), F.count_if(F.col("write")).alias("edits"))


def carry_forward(now: DataFrame, before: DataFrame, key: str = "name") -> DataFrame:
    """Union of the day sets of this and the previous run, and how many the previous one adds."""
    b = before.select(key, F.col("days").alias("_before"))
    none = F.array().cast("array<int>")
    joined = now.join(b, key, "full_outer")
    days = F.array_sort(F.array_union(F.coalesce("days", none), F.coalesce("_before", none)))
    return joined.select(key, days.alias("days"), (F.size(days) - F.size(F.coalesce("days", none))).cast("long").alias("carried"))


def agent_names(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Name of each owner: last agent name, else last title (each only if it speaks of the owner), else registry, else stated, else owner.

    Lines hold owner, delegated, line_no, agent_name, custom_title, of_session and stated; delegated lines never name.
    """
    main = lines.where("NOT delegated")

    def last(col: str):
        return F.max_by(F.struct(F.col(col).alias("name"), (F.col("of_session") == F.col("owner")).alias("own")), F.when(F.col(col).isNotNull(), F.col("line_no")))

    def usable(col: str):
        s = F.col(col)
        return F.when(s["own"] & F.octet_length(s["name"]).between(1, 40), s["name"])

    got = main.groupBy("owner").agg(last("agent_name").alias("a"), last("custom_title").alias("c"), F.min_by("stated", F.when(F.col("stated").isNotNull(), F.col("line_no"))).alias("s"))
    joined = got.join(registry.select(F.col("session_id").alias("owner"), F.col("name").alias("r")), "owner", "left")
    return joined.select("owner", F.coalesce(usable("a"), usable("c"), F.nullif("r", F.lit("")), F.nullif("s", F.lit("")), "owner").alias("name"))


def without_titling(lines: DataFrame) -> DataFrame:
    """Drops transcripts that only title others: no tool use, and a title line or the titling prompt."""
    bad = lines.groupBy("file").agg(F.bool_or("has_tool_use").alias("t"), F.bool_or("is_titling").alias("x")).where("NOT t AND x").select("file")
    return lines.join(bad, "file", "left_anti")


def activity_span(lines: DataFrame, by: list[str]) -> DataFrame:
    """First and last activity (stamps compare as text)."""
    return lines.groupBy(*by).agg(F.min("stamp").alias("earliest"), F.max("stamp").alias("latest"))


def works_on(facts: list[DataFrame], query: str, aliases: DataFrame | None = None) -> DataFrame:
    """Agents and paths whose path, or any former name of it, holds the trimmed query in any case.

    ``facts`` (tool, shell, commit, remote) have agent, path and any of host, reads, edits, commits.
    """
    q = query.strip().lower()
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    hit = F.coalesce(F.lower("path").contains(q), F.lit(False))
    found = every.where(hit)  # on the path alone, so it is pushed below the facts' aggregates and joins
    if aliases is not None:
        old = aliases.where(F.lower("former").contains(q)).select("path")
        found = found.unionByName(every.where(~hit).join(old, "path", "left_semi").select(*every.columns))
    every = found
    keys = [c for c in ("agent", "host", "path") if c in every.columns]
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("reads", "edits", "commits") if c in every.columns]
    return every.groupBy(*keys).agg(*sums)


def top_places(facts: DataFrame, by: str, weight: str, name: str, k: int) -> DataFrame:
    """The k heaviest names of each group, ties by name (an agent's places, machines, notes)."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(weight), name))
    return facts.withColumn("place", rn).where(F.col("place") <= k)


def name_of_session(sessions: DataFrame) -> DataFrame:
    """(session, agent): of the agents (agent, session, rank) that have a session, the first in rank and then name."""
    return sessions.groupBy("session").agg(F.min_by("agent", F.struct("rank", "agent")).alias("agent"))


def tool_uses(calls: DataFrame, code_root: str) -> DataFrame:
    """Reads and edits of each agent and path under the code root by completed tool calls (agent, path, role, verdict)."""
    from ..functions.paths import attributable, relative_to

    rel = _once(path=relative_to(F.col("path"), code_root))
    done = calls.where("verdict = 'ok'").select("agent", "role", rel).where(attributable(F.col("path")))
    return done.groupBy("agent", "path").agg(F.count_if(F.col("role") == "read").alias("reads"), F.count_if(F.col("role") == "write").alias("edits"))


def memory_uses(calls: DataFrame, shell: DataFrame, memory_root: str) -> DataFrame:
    """Uses of each note by agent: tool calls (agent, path, role, verdict) that were completed, and shell uses
    (agent, path, write, verdict, reached), which count as certain by admission and as possible else."""
    from ..functions.paths import memory_of
    from .outcomes import admits

    memory = _once(memory=memory_of(F.col("path"), memory_root))
    tool = calls.where("verdict = 'ok'").select("agent", memory, (F.col("role") == "write").alias("write"), F.lit(True).alias("sure"))
    sure = admits(F.col("verdict"), F.col("reached"))
    ran = shell.where("verdict <> 'rejected'").select("agent", memory, "write", sure.alias("sure"))
    w, s = F.col("write"), F.col("sure")
    counts = [F.count_if(~w & s).alias("reads"), F.count_if(w & s).alias("edits"), F.count_if(~w & ~s).alias("maybe_reads"), F.count_if(w & ~s).alias("maybe_edits")]
    return tool.unionByName(ran).where("memory IS NOT NULL").groupBy("agent", "memory").agg(*counts)


def transcript_counts(files: DataFrame) -> DataFrame:
    """Per agent its own and delegated transcripts and the sessions that own them (agent, owner, delegated)."""
    return files.groupBy("agent").agg(F.count_if(~F.col("delegated")).alias("transcripts"), F.count_if("delegated").alias("delegated"), F.count_distinct("owner").alias("sessions"))


def work_order(files: DataFrame) -> DataFrame:
    """Files of a match (agent, path, edits, reads): most edited, then most read, then by path, within each agent."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("edits"), F.desc("reads"), "path"))
    return files.withColumn("place", rn)


def work_matches(files: DataFrame) -> DataFrame:
    """Agents of a match with the sums of their files, in the same order by name."""
    return files.groupBy(F.col("agent").alias("name")).agg(F.sum("edits").alias("edits"), F.sum("reads").alias("reads")).orderBy(F.desc("edits"), F.desc("reads"), "name")


#: How many places, machines and notes an agent's page shows.
PLACES, MACHINES, KNOWN = 6, 4, 5


def agent_page(tool: DataFrame, recent: DataFrame, remote: DataFrame, memories: DataFrame) -> DataFrame:
    """Rows (agent, what, name, reads, writes, share, place) of an agent's page.

    Places (tool: agent, project, reads, writes, of calls and shell together) go by recent writing, with
    recent reading as a thousandth of it (recent: agent, project, read, wrote), as a share of the agent's
    greatest; machines (agent, host, reads, edits) by all uses; notes (agent, memory, reads, edits) by all
    uses and then edits; ``total`` rows sum the places.
    """
    def top(df, by, k):
        from pyspark.sql import Window

        return df.withColumn("place", F.row_number().over(Window.partitionBy("agent").orderBy(*by))).where(F.col("place") <= k)

    weight = F.coalesce("wrote", F.lit(0.0)) + F.coalesce("read", F.lit(0.0)) / 1000
    seen = tool.join(recent, ["agent", "project"], "left").select("agent", F.col("project").alias("name"), "reads", "writes", weight.alias("w"))
    most = seen.groupBy("agent").agg(F.max("w").alias("top"))
    places = top(seen, [F.desc("w"), F.desc("writes"), "name"], PLACES).join(most, "agent").withColumn("share", F.coalesce(F.try_divide("w", "top"), F.lit(0.0)))
    hosts = remote.groupBy("agent", F.col("host").alias("name")).agg(F.sum("reads").alias("reads"), F.sum("edits").alias("writes"))
    machines = top(hosts, [F.desc(F.col("reads") + F.col("writes")), "name"], MACHINES)
    notes = memories.select("agent", F.col("memory").alias("name"), "reads", F.col("edits").alias("writes"))
    known = top(notes, [F.desc(F.col("reads") + F.col("writes")), F.desc("writes"), "name"], KNOWN)
    total = tool.groupBy("agent").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes")).withColumn("name", F.lit("")).withColumn("place", F.lit(0))
    parts = [("place", places), ("machine", machines), ("note", known), ("total", total)]
    cols = lambda what, df: df.select("agent", F.lit(what).alias("what"), "name", "reads", "writes", (F.col("share") if what == "place" else F.lit(None).cast("double")).alias("share"), "place")
    return reduce(DataFrame.unionByName, [cols(what, df) for what, df in parts])
