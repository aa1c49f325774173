"""Lineage closures, downstream counts and the order of a migration plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import Appended, cut_lineage, number_rows, stored_table


def follow(steps: DataFrame, keys: Sequence[str], state: Sequence[str],
           merge: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]
           ) -> DataFrame:
    """Leads every node along its only upstream node until that one is not in `steps` itself.

    `steps(*keys, node, up, *state)` holds each node once.  `merge(upper, lower)` gives the state
    of a run of nodes from the states of its two parts.  Every round doubles the length of what a
    row stands for, so the rounds grow with the logarithm of the longest run.  Nodes of a cycle,
    and below one, never get out; they come back with `stuck`.
    """
    on = [*keys, "up"]
    now = cut_lineage(steps.withColumn("stuck", F.lit(True)))
    rounds = now.count().bit_length() + 1  # what leaves the set has left it before the last
    for _ in range(rounds):
        upper = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("further"),
                           *[F.col(c).alias(f"upper_{c}") for c in state])
        met = now.join(upper, on, "left")
        further = F.col("further").isNotNull()
        merged = merge(lambda c: F.col(f"upper_{c}"), F.col)
        # under other names first: in a lambda, a name means the column of this select
        met = met.select(*keys, "node", F.coalesce("further", "up").alias("_up"),
                         *[F.when(further, merged[c]).otherwise(F.col(c)).alias(f"_{c}") for c in state],
                         further.alias("stuck"))
        now = cut_lineage(met.withColumnsRenamed({f"_{c}": c for c in ("up", *state)}))
        if now.where("stuck").isEmpty():
            break
    return now


def closure(edges: DataFrame, starts: DataFrame | None = None,
            max_hops: int | None = None) -> DataFrame:
    """(start, node, hop): everything reachable downstream, each node once at its first hop.

    `edges(up, down)`; every node with an outgoing edge is a start unless given.  A start is not
    listed as reached from itself.

    Nodes with one upstream node are first led to where their run begins (`follow`), so the search
    only steps from one place where paths meet to the next, and long runs cost no rounds.  A path
    found later may be shorter; only what improved is searched on from, so cycles end.
    """
    e = cut_lineage(edges.select("up", "down").where(F.col("up") != F.col("down")).distinct())
    start = (e.select(F.col("up").alias("start")) if starts is None
             else starts.select("start")).distinct()
    into = e.groupBy(F.col("down").alias("node")).agg(F.count("*").alias("ways"),
                                                      F.first("up").alias("up"))
    inner = (into.where(F.col("ways") == 1).select("node", "up", F.lit(1).alias("far"))
             .join(start, F.col("node") == F.col("start"), "left_anti"))
    inner = cut_lineage(follow(inner, [], ["far"], lambda upper, lower: {
        "far": upper("far") + lower("far")}).where(~F.col("stuck")).drop("stuck"))
    # edges into places where paths meet, from the place where the run above them begins
    above = inner.select(F.col("node").alias("up"), F.col("up").alias("top"), "far")
    jumps = e.join(inner.select(F.col("node").alias("down")), "down", "left_anti").join(
        above, "up", "left").select(F.coalesce("top", "up").alias("top"), "down",
                                    (F.coalesce("far", F.lit(0)) + 1).alias("far"))
    jumps = cut_lineage(jumps.groupBy("top", "down").agg(F.min("far").alias("far")))
    near = F.lit(True) if max_hops is None else F.col("hop") <= max_hops
    seen = fresh = cut_lineage(start.select("start", F.col("start").alias("node"),
                                            F.lit(0).alias("hop")))
    while not fresh.isEmpty():
        found = fresh.join(jumps, F.col("node") == F.col("top")).select(
            "start", F.col("down").alias("node"), (F.col("hop") + F.col("far")).alias("hop"))
        found = found.where(near).groupBy("start", "node").agg(F.min("hop").alias("hop"))
        known = seen.withColumnRenamed("hop", "had")
        fresh = cut_lineage(found.join(known, ["start", "node"], "left").where(
            F.col("had").isNull() | (F.col("hop") < F.col("had"))).select("start", "node", "hop"))
        seen = cut_lineage(seen.unionByName(fresh).groupBy("start", "node").agg(
            F.min("hop").alias("hop")))
    runs = inner.select(F.col("up").alias("top"), F.col("node").alias("inside"), "far")
    inside = seen.join(runs, F.col("node") == F.col("top")).select(
        "start", F.col("inside").alias("node"), (F.col("hop") + F.col("far")).alias("hop"))
    return seen.unionByName(inside.where(near)).where(F.col("start") != F.col("node"))


def downstream_counts(nodes: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """Nodes with the number of distinct nodes within `max_hops` downstream.

    `nodes(node, known)`: a node whose lineage lookup failed (known = false) counts -1.

    Nodes get numbers, close for neighbours in name order, and what a node reaches is kept as bits
    of 64-bit words, one row per node and word in use, merged hop by hop.  (The built-in bitmaps
    take 4 kB for every 32,768 numbers of which one is reached, far more where reach is thin.)
    """
    e = edges.select("up", "down").where(F.col("up") != F.col("down")).distinct()
    names = nodes.select("node").union(e.select("up")).union(e.select("down")).distinct()
    # numbers of a part of the names follow each other, which is all the words need
    ids = cut_lineage(cut_lineage(names.repartitionByRange("node").sortWithinPartitions("node"))
                      .withColumn("id", F.monotonically_increasing_id()))

    def number(of: str):
        return ids.select(F.col("node").alias(of), F.col("id").alias(f"{of}_id"))

    e = cut_lineage(e.join(number("up"), "up").join(number("down"), "down").select(
        F.col("up_id").alias("up"), F.col("down_id").alias("down")))

    def word(c: str) -> Column:
        return F.shiftright(c, 6)

    def bit(c: str) -> Column:
        return F.expr(f"shiftleft(1L, cast({c} & 63 AS int))")

    def merged(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.groupBy("id", "word").agg(F.bit_or("bits").alias("bits")))

    own = e.select(F.col("up").alias("id"), word("down").alias("word"), bit("down").alias("bits"))
    reach, hop, before = merged(own) if max_hops else own.limit(0), 1, None
    while hop < max_hops:
        further = reach.select(F.col("id").alias("down"), "word", "bits").join(e, "down").select(
            F.col("up").alias("id"), "word", "bits")
        reach, hop = merged(own.unionByName(further)), hop + 1
        size = reach.agg(F.sum(F.bit_count("bits"))).first()[0]
        if size == before:
            break  # nothing is farther away
        before = size
    others = F.when(F.col("word") == word("id"), F.col("bits").bitwiseAND(F.bitwise_not(bit("id")))
                    ).otherwise(F.col("bits"))
    n = reach.groupBy("id").agg(F.sum(F.bit_count(others)).alias("downstream"))
    n = n.join(ids, "id").select("node", "downstream")
    return nodes.join(n, "node", "left").withColumn(
        "downstream", F.when(~F.col("known"), -1).otherwise(F.coalesce("downstream", F.lit(0))))


def upstream_datasets(models: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """Every dataset upstream of each model, at any distance."""
    back = edges.select(F.col("down").alias("up"), F.col("up").alias("down"))
    reach = closure(back, models.select(F.col("model").alias("start")))
    return (reach.join(types.where(F.col("type") == "DATASET").select("node"), "node",
                       "left_semi").select(F.col("start").alias("model"),
                                           F.col("node").alias("dataset"), "hop"))


def plan_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Places the nodes of each change so that upstream nodes come first.

    `nodes(change_id, key, tier, name)`, `edges(up, down)`.  Among nodes whose
    upstream nodes are all placed, the smallest (tier, name) goes next; nodes of
    a cycle follow at the end in the same order.

    That order needs no queue.  Let P be the node's upstream node that is placed
    last.  The node's sort key is P's key cut to the entries above the node's own
    (tier, name), followed by that own entry: between P and the node only
    smaller entries can be placed.

    A run of nodes with one upstream node each cuts and extends the key of the node above it by
    what `follow` gathers, its `tail`.  Of runs that part and meet again the one with the greatest
    tail gives the last key, whatever the key above them is, so they are one; a run from a node
    whose key is known gives a key the node below has at least, its `floor`.  A node with one more
    run into it is then part of a longer run.  This is repeated while there are such nodes, as often
    as the logarithm of their number.  Rounds are only taken from one level of what is left, where
    paths from different places meet, to the next.  A round joins the edges with the nodes placed by
    the round before; of the others only those are touched whose count of placed upstream nodes
    grew.  Placed nodes are appended to a table and not read again.
    """
    own = F.struct("tier", "name", "key")
    n = cut_lineage(nodes.withColumn("own", own))

    def side(name: str) -> DataFrame:
        return n.select("change_id", F.col("key").alias(name))

    e = edges.select("up", "down").where(F.col("up") != F.col("down")).distinct()
    e = cut_lineage(e.join(side("down"), "down").join(side("up"), ["change_id", "up"], "left_semi")
                    .select("change_id", "up", "down"))
    into = e.groupBy("change_id", F.col("down").alias("key")).agg(
        F.count("*").alias("need"), F.first("up").alias("up"))
    state = cut_lineage(n.join(into, ["change_id", "key"], "left").na.fill(0, ["need"]))
    none = F.lit(None).cast(state.select(F.array("own").alias("path")).schema["path"].dataType)

    def cut(path: str) -> Column:
        """The key of a node whose upstream nodes give it `path`."""
        return F.concat(F.filter(path, lambda x: x > F.col("own")), F.array("own"))

    def through(path: str, above: str = "above", tail: str = "tail", floor: str = "floor") -> Column:
        """The key at the end of a run, from the key of the node above the run."""
        return F.greatest(floor, F.when(F.col(above).isNull(), F.col(path)).otherwise(
            F.concat(F.filter(path, lambda x: x > F.col(above)), F.col(tail))))

    def longer(steps: DataFrame) -> DataFrame:
        def after(upper: Column, lower) -> Column:
            return F.concat(F.filter(upper, lambda x: x > lower("above")), lower("tail"))

        return follow(steps, ["change_id"], ["above", "tail", "floor"], lambda upper, lower: {
            "above": F.greatest(upper("above"), lower("above")), "tail": after(upper("tail"), lower),
            "floor": F.greatest(lower("floor"), after(upper("floor"), lower))})

    def led(jumps: DataFrame, runs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Jumps (up, down, own, tail, floor) from where the runs above them begin, one from each
        such place that has no known key; `need` of them enter a node, and none if one comes from a
        cycle.  Nodes that none enters any more have keys."""
        ends = runs.select("change_id", F.col("node").alias("up"), F.col("up").alias("top"),
                           F.col("above").alias("over"), F.col("tail").alias("head"),
                           F.col("floor").alias("base"), "stuck")
        met = jumps.withColumn("above", F.get("tail", F.lit(0))).join(ends, ["change_id", "up"], "left")
        met = met.select("change_id", F.coalesce("top", "up").alias("up"), "down", "own",
                         F.when(F.col("head").isNull(), F.col("tail")).when(F.col("above").isNull(), F.col("head"))
                         .otherwise(F.concat(F.filter("head", lambda x: x > F.col("above")), F.col("tail")))
                         .alias("long"), F.greatest("over", "above").alias("most"),
                         through("base").alias("least"), "stuck")
        met = met.join(known.select("change_id", F.col("key").alias("up"), "path"), ["change_id", "up"], "left")
        met = met.select("change_id", F.when(F.col("path").isNull(), F.col("up")).alias("up"), "down", "own",
                         F.when(F.col("path").isNull(), F.col("long")).alias("tail"),
                         F.when(F.col("path").isNull(), F.col("least")).otherwise(
                             through("path", "most", "long", "least")).alias("floor"), "stuck")
        met = stored_table(met.groupBy("change_id", "up", "down", "own").agg(
            F.max("tail").alias("tail"), F.max("floor").alias("floor"), F.max("stuck").alias("stuck")))
        into = met.groupBy("change_id", "down").agg(
            F.count("up").alias("need"), F.max("floor").alias("floor"), F.max("stuck").alias("stuck"))
        met = stored_table(met.drop("floor", "stuck").join(
            into.where(~F.coalesce("stuck", F.lit(False))).drop("stuck"), ["change_id", "down"])
            .where(F.col("up").isNotNull() | (F.col("need") == 0))
            .withColumn("above", F.get("tail", F.lit(0))))  # the greatest of the run comes first
        return (met.where(F.col("need") > 0),
                met.where(F.col("need") == 0).select("change_id", F.col("down").alias("key"), cut("floor").alias("path")))

    single = state.where(F.col("need") == 1).select(
        "change_id", F.col("key").alias("node"), "up", F.col("own").alias("above"),
        F.array("own").alias("tail"), none.alias("floor"))
    meets = state.where(F.col("need") > 1).select("change_id", F.col("key").alias("down"), "own")
    meets = cut_lineage(e.join(meets, ["change_id", "down"]).withColumns({"tail": none, "floor": none}))
    roots = stored_table(state.where(F.col("need") == 0).join(
        e.select("change_id", F.col("up").alias("key")).distinct(), ["change_id", "key"], "left_semi")
        .select("change_id", "key", F.array("own").alias("path")))
    placed = Appended(n.sparkSession, "placed")
    placed.append(roots)
    layers = [longer(single)]
    jumps, fresh = led(meets, layers[0], roots)
    for _ in range(meets.count().bit_length()):
        alone = jumps.where(F.col("need") == 1)
        if alone.isEmpty():
            break
        placed.append(fresh)
        layers.append(longer(alone.select(
            "change_id", F.col("down").alias("node"), "up", F.greatest("above", "own").alias("above"),
            F.coalesce(cut("tail"), F.array("own")).alias("tail"), cut("floor").alias("floor"))))
        jumps, fresh = led(jumps.where(F.col("need") > 1).select("change_id", "up", "down", "own", "tail", "floor"),
                           layers[-1], fresh)
    partial = None
    while not fresh.isEmpty():
        placed.append(fresh)
        met = jumps.join(fresh.withColumnRenamed("key", "up"), ["change_id", "up"]).select(
            "change_id", "down", "own", "need", F.lit(1).cast("long").alias("got"),
            through("path").alias("last"))
        if partial is not None:
            met = met.unionByName(partial)
        # stored, as a checkpoint hands its constraints on and they grow from round to round
        counts = stored_table(met.groupBy("change_id", "down", "own", "need").agg(
            F.sum("got").alias("got"), F.max("last").alias("last")))
        partial = counts.where(F.col("got") < F.col("need"))
        fresh = counts.where(F.col("got") == F.col("need")).select(
            "change_id", F.col("down").alias("key"), cut("last").alias("path"))
    done = placed.read(fresh.schema)
    for runs in reversed(layers):
        inside = runs.where(~F.col("stuck")).join(
            done.withColumnRenamed("key", "up"), ["change_id", "up"]).select(
            "change_id", F.col("node").alias("key"), through("path").alias("path"))
        done = stored_table(done.unionByName(inside))
    # what no edge enters or leaves stands for itself
    ordered = state.drop("up").join(done, ["change_id", "key"], "left")
    cycle = F.col("path").isNull() & (F.col("need") > 0)
    return ordered.withColumn("cycle", cycle.cast("int")).withColumn(
        "path", F.coalesce("path", F.array("own"))).drop("own", "need")


def with_step(ordered: DataFrame) -> DataFrame:
    """Adds the 1-based step number of each node within its change."""
    return number_rows(ordered, ["change_id"], ["cycle", "path"], "step").drop("path", "cycle")
