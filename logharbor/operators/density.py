"""Density clustering (DBSCAN) on a few numeric features and, if wanted, a text; exact, over a grid of cells.

The cell diagonal equals ``eps``: points of one cell are neighbours of each other. A cell
with enough rows therefore consists of core points without any comparison, and clusters
are connected components of cells. Distances are only computed between points of nearly
empty cells and their surroundings, and between cells whose boxes leave it open whether
they touch. Equal points are one weighted point. With a text, a cell holds points of one term
vector, and ``near_vectors`` says which vectors are close enough and how much of ``eps`` they leave.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logharbor.functions.ordering import salted_lookup
from logharbor.functions.stats import fitted, profile, standard_scaled
from logharbor.functions.text import severity
from logharbor.operators.near_texts import box, near_vectors, rarest_first
from logharbor.operators.term_space import TermSpace
from logharbor.operators.tfidf import tokens
from logharbor.session import durable, shuffled

#: Coordinates whose near positions are listed; cells that agree there are compared on the others.
_LISTED = 4
#: The same between points whose texts are already known to be near.
_LISTED_BY_VECTOR = 2


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label``: the smallest node id of each component.

    ``edges`` holds (a, b) pairs of node ids. In each round every node points to its
    smallest smaller neighbour, pointers are followed to their roots, and the graph is
    contracted to the roots with repeated edges dropped. Nodes with a smaller neighbour
    vanish, so at least half of the connected nodes go in every round. Each round is
    written to shared storage.
    """
    labels = nodes.select("node", F.col("node").alias("label"))
    current = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    for _ in range(rounds):
        if current.isEmpty():
            return labels
        parents = _roots(current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        moved = parents.select(F.col("node").alias("label"), F.col("up"))
        labels = durable(
            labels.join(moved, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        )
        root_of = lambda end: F.coalesce(F.col(f"up_{end}"), F.col(end))
        ends = current
        for end in ("a", "b"):
            ends = ends.join(parents.select(F.col("node").alias(end), F.col("up").alias(f"up_{end}")), end, "left")
        contracted = ends.select(
            F.least(root_of("a"), root_of("b")).alias("a"), F.greatest(root_of("a"), root_of("b")).alias("b")
        )
        current = durable(contracted.where("a < b").distinct())
    raise RuntimeError(f"components not settled after {rounds} rounds")


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``node → up`` pointers to the nodes that have none, doubling each time."""
    pointers = durable(parents)
    while True:
        above = pointers.select(F.col("node").alias("up"), F.col("up").alias("further"))
        stepped = pointers.join(above, "up", "left")
        if stepped.where(F.col("further").isNotNull()).isEmpty():
            return pointers
        pointers = durable(stepped.select("node", F.coalesce("further", "up").alias("up")))


def _reach(d: int) -> int:
    """Cells of a coordinate within which points at most a cell diagonal apart can lie."""
    return math.ceil(math.sqrt(d))


def _position(d: int, listed: int) -> Column:
    """The block of ``cell`` in the listed coordinates; its sides are as long as the reach."""
    return F.array(*[F.floor(F.col("cell")[i] / _reach(d)).cast("bigint") for i in range(listed)])


def _with_near_positions(cells: DataFrame, d: int, listed: int) -> DataFrame:
    """Adds ``position``: the cell's own block and those beside it, which hold all cells within reach.

    A row for each of 3 ** listed blocks; a row for each near cell would be many times as many.
    """
    rows = cells
    for i in range(listed):
        rows = rows.select("*", F.explode(F.array(*[F.lit(o).cast("bigint") for o in (-1, 0, 1)])).alias(f"_o{i}"))
    own = _position(d, listed)
    near = F.array(*[own[i] + F.col(f"_o{i}") for i in range(listed)])
    return rows.select(*cells.columns, near.alias("position"))


def _within_reach(d: int, listed: int) -> Column:
    near = F.lit(True)
    for i in range(listed):
        near = near & (F.abs(F.col("cell")[i] - F.col("near_cell")[i]) <= _reach(d))
    return near


def _gap(d: int) -> Column:
    """Squared distance between the boxes of ``cell`` and ``near_cell``, in cell sides."""
    apart = [F.greatest(F.abs(F.col("cell")[i] - F.col("near_cell")[i]) - 1, F.lit(0)) for i in range(d)]
    return sum((a * a for a in apart[1:]), apart[0] * apart[0])


def _squared(a: str, b: str, d: int) -> Column:
    parts = [(F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(d)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def dbscan_points(
    points: DataFrame, d: int, eps: float, min_samples: int, vectors: DataFrame | None = None
) -> DataFrame:
    """``gid, is_core, cluster_id`` for weighted points ``gid, x (array), w``.

    A cluster is named by the smallest gid of its core points; noise has cluster -1. A
    point next to several clusters joins the one with the smallest name. With ``vectors``
    (``vid, near_vid, apart``: squared distance, each vid with itself included) points
    also have a ``vid``, and squared distances of both kinds are added up.
    """
    side = eps / math.sqrt(d)
    limit = eps * eps * (1 + 1e-12)
    cell = F.transform("x", lambda v: F.floor(v / side).cast("bigint"))
    if vectors is None:
        gridded = durable(points.withColumn("cell", cell))
    else:
        gridded = durable(points.withColumn("cell", F.concat(cell, F.array("vid"))).drop("vid"))
    cells = gridded.groupBy("cell").agg(F.sum("w").alias("weight"), F.min("gid").alias("node"))
    listed = min(d, _LISTED if vectors is None else _LISTED_BY_VECTOR)
    position = _position(d, listed)
    others = cells.select(position.alias("position"), F.col("cell").alias("near_cell"), F.col("node").alias("near_node"))
    if vectors is None:
        around = _with_near_positions(cells.withColumn("apart", F.lit(0.0)), d, listed)
        met = shuffled(around).join(others, "position").where(_within_reach(d, listed) & (_gap(d) <= d))
    else:
        cells, others = durable(cells), others.withColumn("near_vid", F.col("near_cell")[d])
        around = shuffled(cells.withColumn("vid", F.col("cell")[d])).join(vectors, "vid").drop("vid")
        met = shuffled(_with_near_positions(around, d, listed)).join(others, ["near_vid", "position"]).drop("near_vid")
        met = met.where(_within_reach(d, listed) & (_gap(d) * (side * side) + F.col("apart") <= limit))
    near = durable(met.drop("position"))
    sparse_near = near.where(F.col("weight") < min_samples).select("cell", "near_cell", "apart")
    # A sparse cell holds fewer than ``min_samples`` rows, so each point of the
    # surroundings meets a bounded number of partners.
    meetings = durable(
        shuffled(gridded.select("cell", F.col("gid"), F.col("x").alias("p"))).join(sparse_near, "cell").join(
            shuffled(gridded.select(F.col("cell").alias("near_cell"), F.col("gid").alias("other"), F.col("x").alias("q"), "w")),
            "near_cell",
        )
        .where(_squared("p", "q", d) + F.col("apart") <= limit)
        .select("gid", "other", "w")
    )
    counted = meetings.groupBy("gid").agg(F.sum("w").alias("reached"))
    flagged = durable(
        shuffled(gridded).join(cells.select("cell", "weight", "node"), "cell")
        .join(shuffled(counted), "gid", "left")
        .select(
            "gid", "x", "cell", "node",
            ((F.col("weight") >= min_samples) | (F.coalesce("reached", F.lit(0)) >= min_samples)).alias("is_core"),
        )
    )
    core = flagged.where("is_core")
    ends = [F.min(F.col("x")[i]).alias(f"lo{i}") for i in range(d)] + [
        F.max(F.col("x")[i]).alias(f"hi{i}") for i in range(d)
    ]
    boxes = core.groupBy("node").agg(*ends)
    other_boxes = boxes.select(*[F.col(c).alias(f"o_{c}") for c in boxes.columns])
    pairs = (
        near.where(F.col("node") < F.col("near_node"))
        .select(F.col("node"), F.col("near_node").alias("o_node"), "apart")
        .join(shuffled(boxes), "node").join(shuffled(other_boxes), "o_node")
    )
    widest = nearest = F.col("apart")
    for i in range(d):
        lo, hi, olo, ohi = (F.col(c) for c in (f"lo{i}", f"hi{i}", f"o_lo{i}", f"o_hi{i}"))
        reach = F.greatest(F.abs(hi - olo), F.abs(ohi - lo))
        gap = F.greatest(olo - hi, lo - ohi, F.lit(0.0))
        widest, nearest = widest + reach * reach, nearest + gap * gap
    judged = pairs.select("node", "o_node", "apart", widest.alias("widest"), nearest.alias("nearest"))
    sure = judged.where(F.col("widest") <= limit)
    open_pairs = judged.where((F.col("widest") > limit) & (F.col("nearest") <= limit))
    touching = (
        open_pairs.join(shuffled(core.select("node", F.col("x").alias("p"))), "node")
        .join(shuffled(core.select(F.col("node").alias("o_node"), F.col("x").alias("q"))), "o_node")
        .where(_squared("p", "q", d) + F.col("apart") <= limit)
    )
    edges = sure.select(F.col("node").alias("a"), F.col("o_node").alias("b")).unionByName(
        touching.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()
    )
    components = connected_components(boxes.select("node"), edges)
    placed = shuffled(core).join(components, "node")
    names = placed.groupBy("label").agg(F.min("gid").alias("cluster_id"))
    core_clusters = placed.join(names, "label").select("gid", "cluster_id")
    border = (
        shuffled(meetings).join(core_clusters.select(F.col("gid").alias("other"), "cluster_id"), "other")
        .groupBy("gid").agg(F.min("cluster_id").alias("near_cluster"))
    )
    return (
        shuffled(flagged).join(core_clusters, "gid", "left").join(shuffled(border), "gid", "left")
        .select(
            "gid", "is_core",
            F.coalesce("cluster_id", "near_cluster", F.lit(-1).cast("bigint")).alias("cluster_id"),
        )
    )


def detect_density(
    df: DataFrame,
    features: Sequence[str],
    eps: float = 0.5,
    min_samples: int = 5,
    id_column: str = "line_number",
    text: str | None = None,
    max_features: int = 1000,
) -> DataFrame:
    """Adds ``is_core``, ``cluster_id``, ``anomaly_score`` (-1 or 0) and ``is_anomaly``.

    With ``text``, TF-IDF vectors of unit length (the ``max_features`` most frequent words, no stop words) stand beside
    the features; ``eps`` must then be below 1. A null text counts as empty; texts without known words have the vector zero,
    which lies 1 away from all others.
    """
    if not features:
        raise ValueError("name at least one feature")
    keys, clustered = list(features), df
    if text is not None:
        if not 0 < eps < 1:
            raise ValueError("with a text, eps must lie between 0 and 1")
        words = df.withColumn("_words", tokens(F.coalesce(F.col(text), F.lit(""))))
        space = TermSpace(max_features).fit(words, "_words")
        # Rows are grouped and joined by the places of their terms, far shorter than the vectors.
        clustered = durable(words.withColumn("_terms", space.known_terms(words, "_words")).drop("_words"))
        keys.append("_terms")
    points = durable(
        clustered.groupBy(*keys).agg(F.min(id_column).alias("gid"), F.count(F.lit(1)).alias("w"))
    )
    placed = points.withColumn("x", F.array(*[F.col(f).cast("double") for f in features]))
    if text is None:
        found = dbscan_points(placed.select("gid", "x", "w"), len(features), eps, min_samples)
    else:
        distinct = placed.groupBy("_terms").agg(F.min("gid").alias("vid"), *box(len(features)))
        vector = rarest_first(distinct, space, "_terms", 1 - eps * eps / 2)
        distinct = durable(distinct.withColumn("_vector", vector))
        # A word alone and the same word twice make one vector.
        ends = [f(c).alias(c) for f, end in ((F.min, "lo"), (F.max, "hi")) for c in (f"{end}{i}" for i in range(len(features)))]
        vids = durable(distinct.groupBy("_vector").agg(F.min("vid").alias("vid"), *ends))
        near = near_vectors(vids, len(features), eps)
        vid_of = shuffled(distinct.select("_terms", "_vector")).join(vids.select("_vector", "vid"), "_vector").drop("_vector")
        named = shuffled(placed.select("gid", "x", "w", "_terms")).join(vid_of, "_terms").drop("_terms")
        found = dbscan_points(named, len(features), eps, min_samples, near)
    known = shuffled(points).join(found, "gid").drop("gid")
    rows = salted_lookup(clustered, known, keys, "w", [id_column]).select(*df.columns, "is_core", "cluster_id")
    noise = F.col("cluster_id") == -1
    return rows.withColumn("anomaly_score", F.when(noise, -1.0).otherwise(0.0)).withColumn(
        "is_anomaly", noise.cast("int")
    )


def detect_message_density(
    logs: DataFrame, eps: float = 0.5, min_samples: int = 5, max_features: int = 1000, id_column: str = "line_number"
) -> DataFrame:
    """``detect_density`` on the words of messages with their length, level, hour and weekday, each scaled to deviation 1.

    Null messages count as empty, unknown levels as INFO, null times as hour and weekday 0.
    """
    measures = {
        "_length": F.coalesce(F.length("message"), F.lit(0)),
        "_level": severity(F.col("level"), "four_level"),
        "_hour": F.coalesce(F.hour("timestamp"), F.lit(0)),
        "_weekday": F.coalesce(F.weekday("timestamp"), F.lit(0)),
    }
    rows = logs.withColumns(measures)
    stats = fitted(profile(rows, list(measures), quartiles=False))
    rows = rows.withColumns(
        {c: standard_scaled(F.col(c), stats[f"{c}_mean"], stats[f"{c}_std"]) for c in measures}
    )
    found = detect_density(rows, list(measures), eps, min_samples, id_column, "message", max_features)
    return found.drop(*measures)
