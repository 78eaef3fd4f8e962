"""News candidates: headlines of a run clustered newest first, copies discounted, candidates scored.

Clustering depends on the order of articles, so a run, whole, is read in order by one task; runs are dealt over all tasks and are
independent of each other.  A task keeps no articles, but the first members and different titles of the clusters of the run at
hand.  Everything before and after it is declarative.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..functions import headlines
from ..sources.landing import folder, landed
from .mentions import places
from .ordered import ranked

THRESHOLD, MEMBERS, COPY = 0.42, 5, 0.82
#: Titles whose nearest cluster, and pairs of titles whose ratio, a task remembers.
REMEMBERED, PAIRS = 20_000, 200_000
_RATIOS: dict[tuple[str, str], bool] = {}


def _similar(a: tuple, b: tuple) -> float:
    if a[1] & b[1] and a[2] & b[2]:
        return 0.5
    shared = len(a[0] & b[0])
    return shared / max(1, min(len(a[0]), len(b[0]))) if shared >= 4 else 0.0


def _copies(title: str, other: SequenceMatcher) -> bool:
    """Whether the ratio reaches COPY; its upper bounds are asked first."""
    other.set_seq1(title)
    if other.real_quick_ratio() < COPY or other.quick_ratio() < COPY:
        return False
    # Headlines recur in other runs.
    if (pair := (title, other.b)) not in _RATIOS:
        if len(_RATIOS) >= PAIRS:
            _RATIOS.clear()
        _RATIOS[pair] = other.ratio() >= COPY
    return _RATIOS[pair]


class _Clusters:
    """The clusters of a run, of which articles come newest first.

    A pair or word leads to the members that have it, so an article is compared with no others.  What is nearest to an article
    stays so until a cluster takes a member.
    """

    def __init__(self):
        self.members: list[list[tuple]] = []
        self.kept: list[list[SequenceMatcher]] = []
        self.met: list[set[str]] = []
        self.having: dict[tuple, list[tuple[int, tuple]]] = {}
        self.nearest: dict[tuple, tuple[int, int]] = {}
        self.taken = 0

    def _near(self, article: tuple) -> int:
        """The first of the most similar clusters, or -1."""
        at, best = self.nearest.get(article, (-1, -1))
        if at == self.taken:
            return best
        met = {(k, id(m)): m for kind, keys in enumerate(article) for key in keys for k, m in self.having.get((kind, key), ())}
        most, best = THRESHOLD, -1
        for (k, _), member in met.items():
            near = _similar(article, member)
            if near > most or (near == most and (best < 0 or k < best)):
                best, most = k, near
        if len(self.nearest) >= REMEMBERED:
            self.nearest.clear()
        self.nearest[article] = self.taken, best
        return best

    def put(self, article: tuple, title: str) -> tuple[int, bool]:
        """Its cluster, and whether it represents it: it copies no other representative."""
        best = self._near(article)
        if best < 0:
            best = len(self.members)
            self.members.append([])
            self.kept.append([])
            self.met.append(set())
        if len(self.members[best]) < MEMBERS:
            if article not in self.members[best]:
                self.taken += 1
                for kind, keys in enumerate(article):
                    for key in keys:
                        self.having.setdefault((kind, key), []).append((best, article))
            self.members[best].append(article)
        # A title that the cluster has met is a representative's or a copy's, so it is a copy again.
        copy = title in self.met[best] or any(_copies(title, other) for other in self.kept[best])
        self.met[best].add(title)
        if not copy:
            self.kept[best].append(SequenceMatcher(None, "", title))
        return best, not copy


def greedy(run: pd.DataFrame) -> pd.DataFrame:
    """Each article, newest first, joins the most similar cluster by its first members, or opens one; in a cluster it is
    a representative unless it copies one."""
    run = run.sort_values(["published_at", "url"], ascending=[False, True], kind="stable")
    clusters = _Clusters()
    put = [clusters.put((frozenset(pairs), frozenset(long), frozenset(specific)), title) for pairs, long, specific, title in zip(run["pairs"], run["long"], run["specific"], run["normalised"])]
    return pd.DataFrame({"run": run["run"], "url": run["url"], "cluster": [k for k, _ in put], "representative": [own for _, own in put]})


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Articles of whole runs, one run after the other and each newest first, with cluster and representative.

    Ahead of a run's articles are its different titles with their signatures, which only these have: the last five columns are
    whether a row is an article, and normalised, pairs, long and specific.
    """
    run, clusters, signed = None, None, {}
    for batch in batches:
        n, numbers, own = batch.num_columns - 5, [], []
        known = batch.column(n)
        runs, titles = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("run", "title"))
        for i, (of, title, article) in enumerate(zip(runs, titles, known.to_pylist())):
            if clusters is None or of != run:
                run, clusters, signed = of, _Clusters(), {}
            if not article:
                # A title that is null has neither letters nor words.
                signed[title] = tuple(frozenset(batch.column(n + 2 + k)[i].as_py() or ()) for k in range(3)), batch.column(n + 1)[i].as_py() or ""
                continue
            k, first = clusters.put(*signed[title])
            numbers.append(k)
            own.append(first)
        kept = [c.filter(known) for c in batch.columns[:n]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), pa.array(own, pa.bool_())], names=[*batch.schema.names[:n], "cluster", "representative"])


def newest(articles: DataFrame) -> DataFrame:
    """One article per run and URL, the newest."""
    return ranked(articles, ["run", "url"], [F.col("published_at").desc(), F.col("title")], "__rank").where("__rank = 1").drop("__rank")


def clustered(articles: DataFrame) -> DataFrame:
    """``articles`` (run, url, title, publisher, published_at, first_seen) with cluster and representative: all of each run."""
    titles = articles.select("run", "title").distinct().select("run", "title", headlines.normalised(F.col("title")).alias("__normalised"), headlines.signature(F.col("title")).alias("__s"))
    rows = newest(articles).withColumn("__article", F.lit(True))
    every = rows.unionByName(titles.select("run", "title", F.lit(False).alias("__article"), "__normalised", *[F.col(f"__s.{c}").alias(f"__{c}") for c in ("pairs", "long", "specific")]), allowMissingColumns=True)
    # As a run is one task's, runs are dealt out even where their rows are small.
    tasks = 4 * articles.sparkSession.sparkContext.defaultParallelism
    along = every.repartition(tasks, "run").sortWithinPartitions("run", "__article", F.col("published_at").desc(), F.col("url").asc_nulls_last())
    return along.mapInArrow(_along, StructType([*articles.schema.fields, StructField("cluster", IntegerType()), StructField("representative", BooleanType())]))


def similar_titles(articles: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(run, left, right, similarity): different titles of a run, left before right, whose similarity is ``least`` or more.

    Titles of a run that are made of the same pairs and words form a class.  Classes are numbered within the run and meet in an
    index of pairs, long and specific words, where what two of them share is counted; titles come back only to similar classes.
    """
    kept = articles.select("run", "title").distinct().withColumn("s", headlines.signature(F.col("title")))
    sets = [F.array_sort(f"s.{c}").alias(c) for c in ("pairs", "long", "specific")]
    classes = kept.groupBy("run", *sets).agg(F.array_sort(F.collect_list("title")).alias("titles"))
    classes = ranked(classes, ["run"], [F.get("titles", F.lit(0))], "class")
    # Read three times, and the numbers must stay.
    classes = landed(classes, f"{folder(articles.sparkSession, 'titles')}/classes")
    tag = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    index = classes.select("run", "class", F.size("pairs").alias("n"), F.explode(F.concat(tag("pairs", 0), tag("long", 1), tag("specific", 2))).alias("k")).select("run", "k.kind", "k.key", "class", "n")
    met = index.select("run", "kind", "key", F.col("class").alias("a"), F.col("n").alias("na")).join(index.select("run", "kind", "key", F.col("class").alias("b"), F.col("n").alias("nb")), ["run", "kind", "key"]).where("a <= b")
    shared = met.groupBy("run", "a", "b", "na", "nb").agg(F.count_if(F.col("kind") == 0).alias("shared"), F.bool_or(F.col("kind") == 1).alias("long"), F.bool_or(F.col("kind") == 2).alias("specific"))
    overlap = F.when(F.col("shared") >= 4, F.col("shared") / F.greatest(F.lit(1), F.least("na", "nb"))).otherwise(0.0)
    alike = shared.withColumn("similarity", F.when(F.col("long") & F.col("specific"), 0.5).otherwise(overlap)).where(F.col("similarity") >= least)
    of = lambda c: classes.select("run", F.col("class").alias(c), F.col("titles").alias(f"of_{c}"))
    titles = alike.select("run", "a", "b", "similarity").join(of("a"), ["run", "a"]).join(of("b"), ["run", "b"])
    each = titles.select("run", "similarity", "a", "b", F.explode("of_a").alias("x"), "of_b").select("run", "similarity", "a", "b", "x", F.explode("of_b").alias("y"))
    return each.where("a < b OR x < y").select("run", F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "similarity")


def trend_matches(articles: DataFrame, trends: DataFrame) -> DataFrame:
    """(run, url, keyword): search keywords of two or more characters that stand, without spaces, in a normalised title."""
    asked = trends.where(F.length("keyword") >= 2).select("run", "keyword", F.replace("keyword", F.lit(" "), F.lit("")).alias("__needle")).distinct()
    titles = articles.select("run", "url", headlines.normalised(F.col("title")).alias("__title"))
    met = places(titles, ["run", "url"], "__title", asked, "__needle").select("run", "url", F.col("surface").alias("__needle")).distinct()
    return met.join(asked, ["run", "__needle"]).select("run", "url", "keyword")


def candidates(clusters: DataFrame, runs: DataFrame, trends: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` best clusters of each run by score and time; ``runs`` has run, now and baseline."""
    # Clusters are read twice, and found in Python: once is enough.
    clusters = landed(clusters, f"{folder(clusters.sparkSession, 'candidates')}/clusters")
    hit = trend_matches(clusters, trends).select("run", "url").distinct().withColumn("__hit", F.lit(True))
    df = clusters.join(hit, ["run", "url"], "left").join(runs, "run")
    seen, now, hours = F.coalesce("first_seen", "published_at"), F.col("now"), lambda n: F.expr(f"INTERVAL {n} HOURS")
    lead = F.max_by(F.struct("title", "published_at"), F.struct(F.size(headlines.pairs(F.col("title"))), "published_at", "url"))
    grouped = df.groupBy("run", "cluster", "now", "baseline").agg(
        lead.alias("lead"),
        F.count("*").alias("articles"),
        F.count_if("representative").alias("signals"),
        F.size(F.collect_set("publisher")).alias("publishers"),
        F.filter(F.array(*[F.when(F.bool_or(F.col("title").contains(w)), w) for w in headlines.VALUE]), lambda w: w.isNotNull()).alias("value_words"),
        F.count_if((seen > now - hours(6)) & (seen <= now)).alias("recent"),
        F.count_if((seen > now - hours(12)) & (seen <= now - hours(6))).alias("previous"),
        F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("searched"),
        F.max("published_at").alias("published_at"),
        F.concat(F.lit("news_"), F.left(F.sha2(F.min("url"), 256), F.lit(16))).alias("id"),
    )
    growth = F.when(~F.col("baseline"), "no-baseline").when((F.col("recent") > 0) & (F.col("previous") == 0), "new").when(F.col("recent") > F.col("previous"), "rising").otherwise("steady")
    points = lambda n, most: F.least(F.lit(most), 5 * n)
    fresh = F.col("now") - F.expr("INTERVAL 24 HOURS") < F.col("lead.published_at")
    score = points(F.col("signals"), 30) + points(F.col("publishers"), 20) + points(F.size("value_words"), 20) + F.when(F.col("searched"), 10).otherwise(0) + F.when(fresh, 10).otherwise(0)
    df = grouped.withColumn("growth", growth).withColumn("score", score + F.when(F.col("growth") == "rising", 10).otherwise(0))
    best = ranked(df, ["run"], [F.col("score").desc(), F.col("published_at").desc(), F.col("id")]).where(F.col("rank") <= limit)
    return best.select("run", "rank", "id", F.col("lead.title").alias("title"), "score", "articles", "publishers", "signals", "growth", "recent", "previous", "searched", F.array_join("value_words", ",").alias("value_words"), "published_at")
