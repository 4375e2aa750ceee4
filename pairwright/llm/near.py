"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Every text gives its set of shingle hashes and, as a sketch, the ``K`` smallest of
   them.  Equal sets form one class; from here on a class is one node.
2. Inverted lists of neighbours, retained values that follow each other in a sketch, find
   candidates.  Two nodes at the threshold share at least ``SHARED`` of their ``INDEXED - 1``
   pairs of neighbours but for a chance below 1e-7, so they also meet ``MET`` times in the
   lists of all but ``SHARED - MET`` of them, those that are rarest in the corpus.  The
   common ones of a node are in no list.  Single values are met by chance in any large
   corpus, pairs of neighbours hardly ever but in like texts.  Sets smaller than the sketch
   are known whole, and their bound is certain.
3. The smallest ``K`` values of the union of two sketches estimate their resemblance; a
   pair far below the threshold goes (again a chance below 1e-7 for one at it).
4. The exact Jaccard coefficient of the full sets decides.

A list may be long, as in a large group of near copies, so pairs within a list are not
all written.  Each list first meets a leader, the node with the most common values.  A node
that the estimate leaves somewhere near its leader is a satellite of it, known by its
difference, the elements in just one of the two sets.  The leader's place then goes to the
satellite nearest to what most of them hold, and differences are taken from that one.  Then
the nodes of a list meet the leader that most of the list has.  What is linked
becomes one component, and only pairs between components can add to the result:

* Two satellites of one leader are linked only if their differences overlap by a bound that
  grows with both, so inverted lists of the rarer elements, one for each pair of size classes,
  find them.  One of the two is outside the leader's largest component.  Differences decide
  the pair exactly.
* Of the pairs without a common leader, one may be a satellite of the leader that most of the
  list has. Distance, one less the Jaccard coefficient, obeys the triangle inequality: the other
  node, as far from that leader as its estimate surely leaves it, meets only satellites
  that are far enough from the leader to be linked with it (again but for a chance below 1e-7).
  What is left is estimated and then compared by full sets.

No link between components is missed, and none is capped.

Null and empty texts have an empty set and are linked with nothing.  Rows that repeat an
id are rows of their own; a component has the smallest id of its rows (nulls last), and
exactly one of its rows is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.columns import fresh, lower_ascii, whole, with_rows, words
from pairwright.plans.scale import materialize

K = 96  #: values of a sketch
INDEXED = 96  #: of them, those whose neighbours lists are made of
SHARED = 28  #: neighbouring values that linked sketches share at least
MET = 2  #: lists that a pair must share
LIKELY = 0.56  #: least estimate of a pair that is looked at in full
NEAR = 0.4  #: least estimate of a satellite and its leader
STEP = 1.2  #: ratio of the size classes of differences
SURE = 6  #: standard errors between an estimate and the resemblance it leaves possible
RINGS = 20  #: classes of the distance from a leader
BITS = 16  #: places of a bitmap for each row that it holds


def shingles(text: Column, n: int) -> Column:
    """Sorted distinct hashes of the ``n``-word shingles; with fewer words, of the whole."""

    def of(w: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(n)])
        )
        one = F.array(F.xxhash64(w))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= n, several).when(F.size(w) > 0, one).otherwise(none)

    found = F.transform(F.array(words(lower_ascii(whole(text)))), lambda w: F.sort_array(F.array_distinct(of(w))))
    return found[0]


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    rows = docs.select("row", "doc_id", shingles(F.col("text"), n).alias("s"))
    return materialize(
        rows.select(
            "row", "doc_id", F.size("s").alias("n"), F.xxhash64("s").alias("sig"),
            F.xxhash64(F.lit(7), "s").alias("sig2"), F.slice("s", 1, K).alias("bottom"),
        ),
        "sketches",
    )


def _keys(n: Column) -> Column:
    """How many pairs of neighbours the sketch of a set of ``n`` has."""
    return F.least(n, F.lit(INDEXED)) - 1


def _shared(n: Column, percent: int) -> Column:
    """Pairs of neighbours that a set of ``n`` shares with any linked set.

    A set and its partner are whole in their sketches where ``n`` is small.  An element that only
    the set has takes two of its pairs, one that only the partner has takes one, so ``percent`` %
    leave at most ``2 * n * (100 - percent) / 100`` pairs to go.
    """
    gone = F.floor(n * 2 * (100 - percent) / 100).cast("int")
    return F.when(n * 100 < INDEXED * percent, _keys(n) - gone).otherwise(SHARED)


def _meetings(n: Column, percent: int) -> Column:
    """Lists in which a linked pair meets, where ``n`` is the size of the smaller set."""
    return F.least(_shared(n, percent), F.lit(MET))


def _lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(value, node, n, weight): the rarest pairs of neighbours of each node that other nodes have too, hashed.

    ``weight`` is the number of nodes that hold the pairs of the node, summed up.
    """
    first, second = (F.slice("bottom", F.lit(start), _keys(F.col("n"))) for start in (1, 2))
    next_to = F.zip_with(first, second, lambda v, w: F.xxhash64(v, w))
    held = nodes.select(F.col("row").alias("node"), "n", F.explode(next_to).alias("value"))
    common = held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    # values of one node alone come first in order of rarity and need no list
    known = held.join(common, "value").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"), F.sum("df").alias("weight")
    )
    alone = _keys(F.col("n")) - F.size("values")
    listed = _keys(F.col("n")) - _shared(F.col("n"), percent) + _meetings(F.col("n"), percent)
    places = F.greatest(listed - alone, F.lit(0))
    listed = known.select("node", "n", "weight", F.explode(F.slice("values", F.lit(1), places)).alias("v"))
    return materialize(listed.select(F.col("v.value").alias("value"), "node", "n", "weight"), "lists")


def _alike_in_size(percent: int, m: str, n: str) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def _among(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` cut to ``rows`` and, by chance, one in ``BITS`` of the others.

    The rows are known by a bitmap of their hashes, two bytes a row, which goes to the table: rows
    that no pair needs are dropped where they are read and not moved.
    """
    places = F.lit(BITS * max(rows.count(), 1))

    def place(row: str) -> Column:
        return F.pmod(F.xxhash64(row), places)

    held = rows.groupBy(F.bitmap_bucket_number(place("row")).alias("bucket"))
    held = materialize(held.agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("row"))).alias("bitmap")), "row-bitmap")
    at = F.bitmap_bit_position(place("row"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0
    met = table.withColumn("__at", at).join(held, F.bitmap_bucket_number(place("row")) == F.col("bucket"))
    return met.filter(is_set).select(*table.columns)


def _ends(pairs: DataFrame) -> DataFrame:
    """The rows of the pairs (a, b), each once."""
    return materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "pair-rows")


def _estimates(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) with the resemblance that their union sketch of ``size`` values estimates."""
    pairs = materialize(pairs, "met-pairs")
    sketches = _among(sketches, _ends(pairs))
    a = sketches.select(F.col("row").alias("a"), F.col("bottom").alias("x"))
    b = sketches.select(F.col("row").alias("b"), F.col("bottom").alias("y"))
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, K)
    found = F.transform(
        F.array(union),
        lambda u: F.struct(
            (F.size(F.array_intersect(F.array_intersect(u, F.col("x")), F.col("y"))) / F.size(u)).alias("estimate"),
            F.size(u).alias("size"),
        ),
    )
    return pairs.join(a, "a").join(b, "b").select(*pairs.columns, F.inline(found))


def _estimated(pairs: DataFrame, sketches: DataFrame, least: float = LIKELY) -> DataFrame:
    """Pairs (a, b) whose union sketch gives them ``least`` or more; by default those it does not rule out."""
    return materialize(_estimates(pairs, sketches).filter(F.col("estimate") >= least).select("a", "b"), "likely-pairs")


def _compared(pairs: DataFrame, docs: DataFrame, n: int, found: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Pairs (a, b) with the columns ``found`` of their full sets; no text is moved."""
    texts = _among(docs.select("row", "text"), _ends(pairs))
    sets = materialize(texts.select("row", shingles(F.col("text"), n).alias("s")), "pair-sets")
    a = sets.select(F.col("row").alias("a"), F.col("s").alias("x"))
    b = sets.select(F.col("row").alias("b"), F.col("s").alias("y"))
    columns = [of(F.col("x"), F.col("y")).alias(name) for name, of in found.items()]
    return pairs.join(b, "b").join(a, "a").select("a", "b", *columns)


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    found = {"both": lambda x, y: F.size(F.array_intersect(x, y)), "sum": lambda x, y: F.size(x) + F.size(y)}
    linked = F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent
    return materialize(_compared(pairs, docs, n, found).filter(linked).select("a", "b"), "links")


def _linked(m: str, n: str, differ: Column, percent: int) -> Column:
    """Whether sets of ``m`` and ``n`` elements are linked, ``differ`` of them being in just one."""
    total = F.col(m) + F.col(n)
    return (total - differ) * 100 >= (total + differ) * percent


def _either(x: Column, y: Column) -> Column:
    """The elements in just one of two sets."""
    return F.concat(F.array_except(x, y), F.array_except(y, x))


def _satellites(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Pairs of a leader and a node as (hub, node, m, n, delta).

    ``m`` and ``n`` are the sizes of their sets, ``delta`` holds the elements in just one.
    """
    found = {"m": lambda x, y: F.size(x), "n": lambda x, y: F.size(y), "delta": _either}
    rows = _compared(pairs, docs, n, found).withColumnsRenamed({"a": "hub", "b": "node"})
    return materialize(rows, "satellites")


def _recentred(satellites: DataFrame) -> DataFrame:
    """The same groups about the member nearest to the elements that most of the group hold.

    The sum of distances to a group is least at that set, so differences from a member near
    it are short.  Groups that choose the same member become one.
    """
    own = satellites.groupBy("hub").agg(F.max("m").alias("m"), (F.count(F.lit(1)) + 1).alias("members"))
    first = own.select("hub", F.col("hub").alias("node"), "m", F.col("m").alias("n"), F.array().cast("array<bigint>").alias("delta"))
    group = satellites.select("hub", "node", "m", "n", "delta").unionByName(first)
    counts = satellites.select("hub", F.explode("delta").alias("value")).groupBy("hub", "value").agg(F.count(F.lit(1)).alias("df"))
    most = counts.join(own, "hub").filter(F.col("df") * 2 > F.col("members")).groupBy("hub").agg(F.collect_list("value").alias("most"))
    none = F.array().cast("array<bigint>")
    far = group.join(most, "hub", "left").withColumn("far", F.size(_either(F.col("delta"), F.coalesce("most", none))))
    order = F.struct("far", F.xxhash64("node").alias("rank"), "node")
    centres = materialize(
        far.groupBy("hub").agg(F.min_by(F.struct("node", "n", "delta"), order).alias("centre")), "group-centres"
    )
    moved = group.join(centres, "hub").filter(F.col("node") != F.col("centre.node"))
    moved = moved.select(
        F.col("centre.node").alias("hub"), "node", F.col("centre.n").alias("m"), "n",
        _either(F.col("delta"), F.col("centre.delta")).alias("delta"),
    )
    return materialize(moved.dropDuplicates(["hub", "node"]), "centred-satellites")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); the label is one of its nodes.

    Each round merges every node into the neighbour of lowest random rank, which at least
    halves what is left on average, whatever the shape of the graph.
    """
    edges = edges.filter(F.col("a") != F.col("b"))
    labels, turn = None, 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def ranked(c: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("id"))

        lowest = both.groupBy("a").agg(F.min(ranked("b")).alias("near"))
        to = materialize(
            lowest.select(F.col("a").alias("from"), F.least(ranked("a"), F.col("near"))["id"].alias("to")), "merged"
        )
        if labels is None:
            labels = to.select(F.col("from").alias("node"), F.col("to").alias("label"))
        else:
            labels = labels.join(to, F.col("label") == F.col("from"), "left")
            labels = materialize(labels.select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = edges.join(to.withColumnsRenamed({"from": "a", "to": "u"}), "a")
        ends = ends.join(to.withColumnsRenamed({"from": "b", "to": "v"}), "b").filter(F.col("u") != F.col("v"))
        edges = ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        edges, turn = materialize(edges, "edges"), turn + 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _labelled(lists: DataFrame, labels: DataFrame, satellites: DataFrame) -> DataFrame:
    """Rows of the lists that still hold several components and no leader of all, with both.

    ``hubs`` holds the leaders of the node; itself where it has none.
    """
    hubs = satellites.groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    named = lists.join(labels, "node", "left").join(hubs, "node", "left")
    itself = F.array(F.col("node"))
    named = named.select(
        "value", "node", "n", F.coalesce("label", "node").alias("label"),
        F.array_union(F.coalesce("hubs", itself), itself).alias("hubs"),
    )
    named = materialize(named, "labelled-lists")
    mixed = named.groupBy("value").agg(
        F.min("label").alias("p"), F.max("label").alias("q"), F.count(F.lit(1)).alias("rows")
    ).filter("p != q")
    led = named.select("value", F.explode("hubs").alias("hub")).groupBy("value", "hub").agg(F.count(F.lit(1)).alias("of"))
    led = led.groupBy("value").agg(F.max(F.struct("of", F.xxhash64("hub").alias("rank"), "hub")).alias("top"))
    left = mixed.join(led, "value").filter(F.col("top.of") < F.col("rows"))
    return materialize(named.join(left.select("value", F.col("top.hub").alias("top")), "value"), "open-lists")


def _with_common_leaders(open_lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Each node with the leaders that most of its lists' nodes have and it has not."""
    met = open_lists.filter(~F.array_contains("hubs", F.col("top"))).select(F.col("top").alias("a"), F.col("node").alias("b"), "n")
    sizes = nodes.select(F.col("row").alias("a"), F.col("n").alias("m"))
    return met.distinct().join(sizes, "a").filter(_alike_in_size(percent, "m", "n")).select("a", "b")


def _with_leaders(lists: DataFrame, percent: int) -> DataFrame:
    """Each node with the leader it shares the most lists with; a list is led by its node of most weight.

    Nodes that meet in fewer lists than a linked pair are left out.
    """
    chosen = F.struct((-F.col("weight")).alias("first"), F.xxhash64("node").alias("rank"), "node", "n")
    leaders = lists.groupBy("value").agg(F.min(chosen).alias("leader"))
    met = lists.join(leaders, "value").filter(F.col("node") != F.col("leader.node"))
    met = met.withColumn("m", F.col("leader.n")).filter(_alike_in_size(percent, "m", "n"))
    shared = met.groupBy(F.col("leader.node").alias("a"), F.col("node").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.min(F.least("m", "n")).alias("n")
    ).filter(F.col("shared") >= _meetings(F.col("n"), percent))
    best = shared.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best"))
    return best.select(F.col("best.a").alias("a"), "b")


def _at_most(estimate: Column, size: Column) -> Column:
    """The largest resemblance that an estimate leaves possible; sketches below ``K`` are whole sets."""
    k = F.lit(float(SURE**2)) / size
    high = (estimate + k / 2 + F.sqrt(estimate * (1 - estimate) * k + k * k / 4)) / (1 + k)
    return F.when(size < K, estimate).otherwise(high)


def _around_leaders(open_lists: DataFrame, satellites: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The lists with the place of each node about the leader that most of the list has.

    ``at`` is the distance of the leader itself and its satellites; for other nodes it is null, and
    ``beyond`` is the distance from which on a satellite may be linked with them.
    """
    far = open_lists.filter(~F.array_contains("hubs", F.col("top")))
    far = _estimates(far.select(F.col("top").alias("a"), F.col("node").alias("b")).distinct(), sketches)
    beyond = F.lit(percent / 100) - _at_most(F.col("estimate"), F.col("size")) - 1e-9
    far = far.select(F.col("a").alias("top"), F.col("b").alias("node"), beyond.alias("beyond"))
    differ = F.size("delta")
    near = satellites.select(F.col("hub").alias("top"), "node", (differ * 2 / (F.col("m") + F.col("n") + differ)).alias("at"))
    near = near.groupBy("top", "node").agg(F.max("at").alias("at"))
    placed = open_lists.join(near, ["top", "node"], "left").join(far, ["top", "node"], "left")
    placed = placed.withColumn("at", F.when(F.col("top") == F.col("node"), 0.0).otherwise(F.col("at")))
    return materialize(placed.select("value", "node", "n", "label", "hubs", "at", "beyond"), "placed-lists")


def _without_hub(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one list, different components and no common leader that distances do not rule out."""
    ring = F.floor(F.col("at") * RINGS).cast("int")
    first = F.greatest(F.floor(F.col("beyond") * RINGS), F.lit(0)).cast("int")
    outside = placed.filter("at is null").select(
        "value", F.col("node").alias("a"), F.col("n").alias("m"), F.col("label").alias("la"), F.col("hubs").alias("ha"), "beyond", first.alias("first")
    )
    named = [F.col("node").alias("b"), "n", F.col("label").alias("lb"), F.col("hubs").alias("hb")]
    apart = (F.col("la") != F.col("lb")) & _alike_in_size(percent, "m", "n") & ~F.arrays_overlap("ha", "hb")
    # a leader's satellites have it in common, so one of two nodes is none of them
    both = outside.join(placed.filter("at is null").select("value", *named), "value").filter((F.col("a") < F.col("b")) & apart)
    rings = outside.withColumn("ring", F.explode(F.sequence("first", F.lit(RINGS))))
    inside = placed.filter("at is not null").select("value", ring.alias("ring"), "at", *named)
    one = rings.join(inside, ["value", "ring"]).filter((F.col("at") >= F.col("beyond")) & apart)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("m", "n").alias("n")]
    met = both.select(*pair).unionAll(one.select(*pair))
    often = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"), F.min("n").alias("n"))
    return often.filter(F.col("lists") >= _meetings(F.col("n"), percent)).select("a", "b")


def _class(d: Column) -> Column:
    """Size class of a difference: classes end at powers of ``STEP``."""
    return F.floor(F.log(STEP, d + 1)).cast("int")


def _of_one_hub(satellites: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Linked pairs (a, b) of satellites of one leader and different components.

    Sets of sizes p and q are linked when at most ``c * (p + q)`` elements are in just one of
    them, where ``c = (100 - percent) / (100 + percent)``.  With differences of d and e from
    the leader, they then share at least ``(d + e - c * (p + q)) / 2`` elements of these.  As q
    is at most the leader's size and e, this grows with e, so the least e of a size class bounds
    it, and to meet those of the class a node needs only the lists of its
    ``d - bound + 1`` rarest elements.
    """
    named = satellites.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.withColumn("d", F.size("delta"))
    named = materialize(named.withColumn("class", _class(F.col("d"))), "labelled-satellites")
    tops = named.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("of"))
    tops = tops.groupBy("hub").agg(F.max(F.struct("of", "label")).alias("top"), F.sum("of").alias("rows"))
    tops = tops.filter(F.col("top.of") < F.col("rows")).select("hub", F.col("top.label").alias("top"))
    mixed = named.join(materialize(tops, "open-hubs"), "hub").withColumn("outside", F.col("label") != F.col("top"))
    mixed = materialize(mixed.drop("top"), "open-satellites")
    classes = mixed.groupBy("hub").agg(
        F.collect_set("class").alias("all"), F.collect_set(F.when(F.col("outside"), F.col("class"))).alias("out")
    )
    held = mixed.select("hub", "node", F.explode("delta").alias("value"))
    common = held.groupBy("hub", "value").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    known = held.join(common, ["hub", "value"]).groupBy("hub", "node").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values")
    )

    rest, total = 100 - percent, 100 + percent
    low = F.ceil(F.pow(F.lit(STEP), F.col("other")) - 1 - 1e-6)
    high = F.ceil(F.pow(F.lit(STEP), F.col("other") + 1))
    size = F.least(F.col("n") * 100 / percent, F.col("m") + low)
    bound = F.greatest(F.ceil((F.col("d") + low - (F.col("n") + size) * rest / total) / 2 - 1e-6), F.lit(1))
    each = mixed.drop("delta").join(known, ["hub", "node"]).join(classes, "hub").withColumn("other", F.explode("all"))
    each = each.withColumn("bound", bound).filter((F.col("bound") <= F.col("d")) & (F.col("bound") <= high))
    alone = F.col("d") - F.size("values")  # elements that no other satellite holds come first
    each = each.withColumn("places", (F.col("d") - F.col("bound") + 1 - alone).cast("int")).filter("places > 0")
    each = each.filter(F.col("outside") | F.expr("array_contains(out, other)"))
    listed = each.select(
        "hub", "node", "n", "label", "d", "outside", "class", "other", F.expr("array_contains(out, other)").alias("sought"),
        F.explode(F.slice("values", F.lit(1), F.col("places"))["value"]).alias("value"),
    )
    listed = materialize(listed, "difference-lists")
    at = ["hub", "value", "class_a", "class_b"]
    x = listed.filter("outside").select(
        "hub", "value", F.col("class").alias("class_a"), F.col("other").alias("class_b"),
        F.col("node").alias("a"), F.col("n").alias("m"), F.col("label").alias("la"), F.col("d").alias("da"),
    )
    y = listed.filter("sought").select(
        "hub", "value", F.col("other").alias("class_a"), F.col("class").alias("class_b"),
        F.col("node").alias("b"), "n", F.col("label").alias("lb"), F.col("d").alias("db"), "outside",
    )
    once = ~F.col("outside") | (F.col("a") < F.col("b"))  # two outside meet from both sides
    within = F.abs(F.col("da") - F.col("db")) * total <= (F.col("m") + F.col("n")) * rest
    met = x.join(y, at).filter(once & (F.col("la") != F.col("lb")) & _alike_in_size(percent, "m", "n") & within)
    pairs = materialize(met.select("hub", "a", "b").distinct(), "difference-pairs")
    sides = mixed.select("hub", "node", "n", "delta")
    a = sides.select("hub", F.col("node").alias("a"), F.col("n").alias("m"), F.col("delta").alias("x"))
    b = sides.select("hub", F.col("node").alias("b"), "n", F.col("delta").alias("y"))
    differ = F.size("x") + F.size("y") - F.size(F.array_intersect("x", "y")) * 2
    return pairs.join(a, ["hub", "a"]).join(b, ["hub", "b"]).filter(_linked("m", "n", differ, percent)).select("a", "b")


def links(docs: DataFrame, sketches: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, label) of the nodes in components of several."""
    lists = _lists(nodes, percent)
    satellites = _recentred(_satellites(_estimated(_with_leaders(lists, percent), sketches, NEAR), docs, n))

    def led(satellites: DataFrame) -> DataFrame:
        near = satellites.filter(_linked("m", "n", F.size("delta"), percent))
        return near.select(F.col("hub").alias("a"), F.col("node").alias("b"))

    labels = components(led(satellites))
    open_lists = _labelled(lists, labels, satellites)
    more = _estimated(_with_common_leaders(open_lists, nodes, percent), sketches, NEAR)
    satellites = satellites.unionByName(_satellites(more, docs, n).select(*satellites.columns))
    labels = components(led(satellites))
    open_lists = _labelled(lists, labels, satellites)
    placed = _around_leaders(open_lists, satellites, sketches, percent)
    apart = _verified(_estimated(_without_hub(placed, percent), sketches), docs, n, percent)
    edges = led(satellites).union(apart).union(_of_one_hub(satellites, labels, percent))
    return components(materialize(edges, "links"))


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id and kept of every row.

    Sets of ``n``-word shingles are linked from ``percent`` % of Jaccard resemblance on.
    ``row`` names a column that tells rows apart; without one they get a number.
    """
    docs = (docs.withColumn("row", F.col(row)) if row else with_rows(docs)).select("row", "doc_id", "text")
    sketches = _sketches(docs, n)
    some = sketches.filter(F.col("n") > 0)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = some.groupBy("n", "sig", "sig2").agg(F.min("row").alias("node"), F.min(order).alias("first"))
    classes = materialize(classes, "set-classes")
    nodes = some.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    labels = links(docs, sketches.select("row", "bottom"), nodes, n, percent)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = named.groupBy("label").agg(F.min("first").alias("keep"))
    kept = materialize(named.join(firsts, "label").select("n", "sig", "sig2", "keep"), "components")
    rows = sketches.select("row", "doc_id", "n", "sig", "sig2").join(kept, ["n", "sig", "sig2"], "left")
    alone = F.col("keep").isNull()
    return rows.select(
        "row", "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"),
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with the columns of ``docs``."""
    row = fresh(docs, "row_number")
    tagged = with_rows(docs, row)
    stay = near_groups(tagged, n, percent, row).filter("kept").select(F.col("row").alias(row))
    return tagged.join(materialize(stay, "kept-rows").hint("merge"), row, "left_semi").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2
        THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s
    FROM w
), sizes AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), linked AS (
    SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 80 * (x.n + y.n - common)
), edge AS (
    SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(id, place) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.id, edge.b FROM reach JOIN edge ON reach.place = edge.a
), component AS (
    SELECT id, min(place) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN component c ON c.id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""
