"""Entities and people across interviews."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.text import collapse, strip, surface_key
from parlance.plans.closure import connected_components
from parlance.plans.scratch import materialise

AUTO, SUGGEST = 0.92, 0.80
#: Vectors in a tile of the pair join, about.
TILE_ROWS = 2_048
#: Pivots of a block at most, and vectors that are held against them at a time.
PIVOTS, CHUNK_ROWS = 512, 20_000


def surface_counts(mentions: DataFrame) -> DataFrame:
    """Distinct surfaces of each project with how often they are mentioned."""
    return mentions.groupBy("project_id", "surface", "entity_type").agg(F.count(F.lit(1)).alias("mentions"))


def exact_groups(surfaces: DataFrame) -> DataFrame:
    """Groups of equal normalised surface and type; the representative has most mentions, then sorts first."""
    s = surfaces.withColumn("norm", surface_key(F.col("surface")))
    return s.groupBy("project_id", "entity_type", "norm").agg(F.count(F.lit(1)).alias("n_surfaces"), F.sum("mentions").alias("mentions"), F.min_by("surface", F.struct((-F.col("mentions")).alias("m"), "surface")).alias("representative"))


def unit_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """Adds ``unit``: the vector at length 1, or null at length 0."""
    norm = F.sqrt(F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.withColumn("_norm", norm).withColumn("unit", F.when(F.col("_norm") > 0, F.transform(column, lambda x: x.cast("double") / F.col("_norm")))).drop("_norm")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls are a value like any other, as in groupBy."""
    other = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on))
    return left.join(other, same, how).drop(*(f"_of_{c}" for c in on))


def split_cells(vectors: DataFrame, key: str, block: list[str], tile_rows: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(vectors with ``cell`` and ``angle``, the cells' ``(block, cell, at array<double>)``): each vector goes to the nearest pivot of its block.

    Only blocks of more than ``tile_rows`` vectors have pivots: one for so many rows and ``pivots`` at most, drawn by a hash of the keys.
    """
    size = vectors.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    large = materialise(size.where(F.col("_n") > tile_rows).withColumns({"_cells": F.least(F.lit(pivots), F.ceil(F.col("_n") / tile_rows)).cast("int"), "_chunks": F.ceil(F.col("_n") / CHUNK_ROWS).cast("int")}))
    own, none = vectors.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)}), vectors.select(*block, F.lit(0).alias("cell"), F.col("unit").alias("at")).limit(0)
    if large.isEmpty():
        return own, none
    wide = _matched(vectors, large, block)
    h = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30))
    drawn = wide.where(h < F.greatest(F.lit(64), 4 * F.col("_cells")) / F.col("_n") * (1 << 30)).withColumn("cell", F.row_number().over(Window.partitionBy(*block).orderBy(h, key)) - 1).where(F.col("cell") < F.col("_cells"))
    at = materialise(drawn.select(*block, "_chunks", "cell", F.col("unit").alias("at")))
    per_chunk = at.groupBy(*block, "_chunks").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "at"))), lambda c: c["at"]).alias("at")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    chunked = wide.withColumn("_chunk", F.pmod(F.xxhash64(key), F.col("_chunks")).cast("int")).select(*vectors.columns, "_chunk")

    def nearest(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        cosine = np.zeros((len(rows), 1))
        if len(rows) and len(cells):
            cosine = np.stack(rows["unit"].tolist()) @ np.stack(list(cells["at"].iloc[0])).T
        best = cosine.argmax(1)
        return rows.drop(columns="_chunk").astype(dict.fromkeys([key, *block], object)).assign(cell=best.astype(np.int32), angle=np.arccos(np.clip(cosine.max(1, initial=-1), -1, 1)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) + ", cell int, angle double"
    dealt = chunked.groupBy(*block, "_chunk").cogroup(per_chunk.select(*block, "_chunk", "at").groupBy(*block, "_chunk")).applyInPandas(nearest, schema)
    small = _matched(own, large.select(*block), block, "left_anti").select(*dealt.columns)
    return small.unionByName(dealt), at.select(*block, "cell", "at")


def _cell_pairs(cells: DataFrame, at: DataFrame, block: list[str], low: float) -> DataFrame:
    """``(block, cell, other, other_tiles, least)``: which cells can hold partners of a cell's vectors, and from which angle to their pivot on.

    Two vectors of angles a and b to pivots t apart are at least t - a - b apart, so a cell whose radius does not reach is left out, and
    so are vectors too close to their own pivot.  Each pair is given from both sides, a cell with itself once.
    """
    alone = cells.select(*block, "cell", F.col("cell").alias("other"), F.col("tiles").alias("other_tiles"), F.lit(0.0).alias("least"))
    known = _matched(cells, at, [*block, "cell"]).groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("cell", "tiles", "radius", "at"))).alias("cells"))
    reach = float(np.arccos(low - 1e-6)) + 1e-7
    kinds = {c: cells.schema[c].dataType.simpleString() for c in block}

    def pair(frames):
        for f in frames:
            for row in f.to_dict("records"):
                x = row["cells"]
                a = np.stack([c["at"] for c in x])
                apart, radius = np.arccos(np.clip(a @ a.T, -1, 1)), np.array([c["radius"] for c in x])
                least = apart - radius[None, :] - reach
                i, j = np.nonzero((least <= radius[:, None]) & ~np.eye(len(x), dtype=bool))
                cell, tiles = np.array([c["cell"] for c in x], np.int32), np.array([c["tiles"] for c in x], np.int32)
                yield pd.DataFrame({c: pd.Series([row[c]] * len(i), dtype=object) for c in block} | {"cell": cell[i], "other": cell[j], "other_tiles": tiles[j], "least": least[i, j]})

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", cell int, other int, other_tiles int, least double"
    return alone.unionByName(known.mapInPandas(pair, schema))


def _met_tiles(vectors: DataFrame, key: str, block: list[str], column: str, low: float, tile_rows: int, pivots: int) -> DataFrame:
    """Every vector once for each two tiles that it has to be multiplied in: ``(block, ca, ta, cb, tb, cell, tile, key, unit)``."""
    v = materialise(unit_vectors(vectors, column).where("unit is not null").select(key, *block, "unit"))
    if v.groupBy(*block).count().where(F.col("count") > tile_rows).isEmpty():
        # one tile a block
        return v.select(*block, *(F.lit(0).alias(c) for c in ("ca", "ta", "cb", "tb", "cell", "tile")), key, "unit")
    placed, at = split_cells(v, key, block, tile_rows, pivots)
    placed = materialise(placed)
    cells = materialise(placed.groupBy(*block, "cell").agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles")))
    pairs = _cell_pairs(cells, at, block, low)
    rows = _matched(placed, cells.drop("radius"), [*block, "cell"]).withColumn("tile", F.pmod(F.xxhash64(key), F.col("tiles")).cast("int"))
    met = _matched(rows, pairs, [*block, "cell"]).where(F.col("angle") >= F.col("least") - 1e-9).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    mine, theirs = F.struct(F.col("cell").alias("c"), F.col("tile").alias("t")), F.struct(F.col("other").alias("c"), F.col("t"))
    return met.withColumns({"a": F.least(mine, theirs), "b": F.greatest(mine, theirs)}).select(*block, F.col("a.c").alias("ca"), F.col("a.t").alias("ta"), F.col("b.c").alias("cb"), F.col("b.t").alias("tb"), "cell", "tile", key, "unit")


def similar_pairs(vectors: DataFrame, key: str, block: list[str], column: str, low: float = SUGGEST, high: float = AUTO, tile_rows: int = TILE_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Pairs inside a block whose cosine reaches ``low``, with their band; vectors of length 0 match nothing.

    Exact.  A block of more than ``tile_rows`` vectors is cut into cells around pivots; cells too far apart for
    any pair are never brought together (see _cell_pairs), and of the others only vectors that can have a partner
    are.  Cells are cut into tiles of about ``tile_rows`` by a hash; two tiles meet once, as a product of two
    matrices, so a task holds two tiles however large the block is.  Every block has its own pivots and tiles.
    """
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (key, *block)}
    schema = ", ".join([f"{c} {kinds[c]}" for c in block] + [f"a {kinds[key]}, b {kinds[key]}, score double"])

    def multiply(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *names, ca, ta, cb, tb = group
        left, right = (rows[(rows["cell"] == c) & (rows["tile"] == t)].sort_values(key) for c, t in ((ca, ta), (cb, tb)))
        out = {"a": [], "b": [], "score": []}
        if len(left) and len(right):
            x, y = (np.stack(side["unit"].tolist()) for side in (left, right))
            score = np.round(x @ y.T, 6)
            i, j = np.nonzero(np.triu(score >= low, 1) if (ca, ta) == (cb, tb) else score >= low)
            a, b = left[key].to_numpy()[i], right[key].to_numpy()[j]
            swap = a > b
            out = {"a": np.where(swap, b, a), "b": np.where(swap, a, b), "score": score[i, j]}
        f = pd.DataFrame(out)
        for k, (c, value) in enumerate(zip(block, names, strict=True)):
            f.insert(k, c, value)
        return f

    met = _met_tiles(vectors, key, block, column, low, tile_rows, pivots)
    pairs = met.groupBy(*block, "ca", "ta", "cb", "tb").applyInPandas(multiply, schema)
    return pairs.withColumn("band", F.when(F.col("score") >= high, "auto").otherwise("suggest"))


def tile_report(vectors: DataFrame, key: str, block: list[str], column: str, low: float = SUGGEST, tile_rows: int = TILE_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """What similar_pairs reads in each block: vectors, copies of them that are sent, and pairs of tiles that are multiplied."""
    met = _met_tiles(vectors, key, block, column, low, tile_rows, pivots)
    return met.groupBy(*block).agg(F.count_distinct(key).alias("n_vectors"), F.count(F.lit(1)).alias("n_sent"), F.count_distinct("ca", "ta", "cb", "tb").alias("n_tile_pairs"))


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, component) of the automatic pairs."""
    return connected_components(pairs.where("band = 'auto'"), "a", "b")


def assign_canonicals(members: DataFrame, aliases: DataFrame, new_id) -> DataFrame:
    """Owner of each cluster: the one live owner, a new id, or a suggestion when several own parts of it.

    members: component, surface; aliases: surface, canonical_id, locked (live ones only).
    """
    j = members.join(aliases, "surface", "left")
    c = j.groupBy("component").agg(F.array_sort(F.collect_set("canonical_id")).alias("owners"), F.count_if(F.col("canonical_id").isNull()).alias("n_new"), F.coalesce(F.bool_or("locked"), F.lit(False)).alias("locked"))
    n = F.size("owners")
    decision = F.when(n > 1, "suggest").when((n == 1) & F.col("locked") & (F.col("n_new") > 0), "skipped_locked").when(n == 1, "extend").otherwise("create")
    return c.select("component", decision.alias("decision"), F.when(n == 1, F.element_at("owners", 1)).when(n == 0, new_id("component")).alias("canonical_id"), "n_new")


def participant_pool(participants: DataFrame, scope: str) -> DataFrame:
    """First spelling of each name by interview order; participants: scope, interview_id, name."""
    return participants.groupBy(scope, collapse(F.col("name")).alias("name_key")).agg(F.min_by(F.trim("name"), F.struct("interview_id", "name")).alias("spelling"))


def person_groups(speakers: DataFrame, pool: DataFrame, scope: str) -> DataFrame:
    """Speakers of one name in a scope; automatic with two links or a participant of that name.

    Provisional speakers, blank names and names equal to the handle as written take no part.
    speakers: scope, interview_id, speaker_id, handle, display_name, provisional.
    """
    named = speakers.withColumn("display_name", strip(F.col("display_name"))).where(~F.coalesce("provisional", F.lit(False)) & (F.col("display_name") != "") & ~F.col("display_name").eqNullSafe(F.col("handle"))).withColumn("name_key", collapse(F.col("display_name")))
    count = named.groupBy(scope, "name_key", "display_name").agg(F.count(F.lit(1)).alias("n"), F.collect_list("speaker_id").alias("ids"))
    g = count.groupBy(scope, "name_key").agg(F.sum("n").alias("n_links"), F.min_by("display_name", F.struct((-F.col("n")).alias("m"), "display_name")).alias("common"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("speaker_ids"))
    g = g.join(pool, [scope, "name_key"], "left")
    auto = (F.col("n_links") >= 2) | F.col("spelling").isNotNull()
    return g.select(scope, "name_key", F.coalesce("spelling", "common").alias("name"), "n_links", "speaker_ids", auto.alias("auto"), F.when(F.col("spelling").isNotNull(), "front_matter").otherwise("exact_name").alias("method"))


def first_name_suggestions(groups: DataFrame, scope: str) -> DataFrame:
    """Groups that are not automatic and whose first name is that of an automatic person."""
    first = F.split("name_key", " ")[0]
    auto = groups.where("auto").select(scope, first.alias("first"), F.col("name_key").alias("person"))
    rest = groups.where(~F.col("auto")).select(scope, first.alias("first"), "name_key")
    return rest.join(auto, [scope, "first"]).where("name_key != person").select(scope, "name_key", "person", F.lit("first_name_match").alias("method"))


def new_links(links: DataFrame, existing: DataFrame, blocked: DataFrame) -> DataFrame:
    """Adds ``outcome`` to proposed links (person, speaker_id): linked, existing, or blocked."""
    e = existing.select("person", "speaker_id").distinct().withColumn("_e", F.lit(True))
    b = blocked.select("person", "speaker_id").distinct().withColumn("_b", F.lit(True))
    j = links.join(e, ["person", "speaker_id"], "left").join(b, ["person", "speaker_id"], "left")
    return j.withColumn("outcome", F.when(F.col("_b").isNotNull(), "blocked").when(F.col("_e").isNotNull(), "existing").otherwise("linked")).drop("_e", "_b")


def review_suggestions(pairs: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Pairs for a person to judge: the suggest band always; the auto band only when both sides exist, unlocked and unmerged.

    canonicals: surface, canonical_id, locked, merged.
    """
    a = canonicals.select(F.col("surface").alias("a"), F.col("canonical_id").alias("a_id"), F.col("locked").alias("a_l"), F.col("merged").alias("a_m"))
    b = canonicals.select(F.col("surface").alias("b"), F.col("canonical_id").alias("b_id"), F.col("locked").alias("b_l"), F.col("merged").alias("b_m"))
    j = pairs.join(a, "a", "left").join(b, "b", "left")
    both = F.coalesce(~F.col("a_l") & ~F.col("b_l") & ~F.col("a_m") & ~F.col("b_m"), F.lit(False))
    j = j.withColumn("left_id", F.coalesce("a_id", F.concat(F.lit("new:"), "a"))).withColumn("right_id", F.coalesce("b_id", F.concat(F.lit("new:"), "b")))
    return j.where(((F.col("band") == "suggest") | both) & (F.col("left_id") != F.col("right_id"))).select("left_id", "right_id", "a", "b", "band", F.round("score", 4).alias("score"))
