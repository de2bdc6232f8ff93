"""Search surface: predicates (C4-C8), validation (C10), order + paging
(G1, G2), category expansion (H4), placeholder row (H5) and the query
variants J1-J5, J7.

A search is a declarative ``where -> orderBy -> offset/limit`` over the
release table; Catalyst turns it into partition pruning on ``bucket``,
column pruning at the scan and a ``TakeOrderedAndProject`` top-k (each
task keeps only ``offset + limit`` rows, so no full sort/shuffle).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import category as cat
from ..functions import dates as d

ORDER_MAP = {"date": "posted_at", "size": "size_bytes", "title": "norm_title"}

_TOKEN_SPLIT = re.compile(r"[^\w]+|_+", re.UNICODE)


def query_tokens(q: str | None) -> list[str]:
    """Driver-side twin of ``search_tokens``: lower-case letter/digit runs."""
    if not q:
        return []
    return [t for t in _TOKEN_SPLIT.split(q.lower()) if t]


@dataclass
class SearchQuery:
    q: str | None = None
    cat: str | None = None
    tag: str | None = None
    sort: str | None = None
    limit: int = 50
    offset: int = 0
    api_key: str | None = None
    has_vector: bool = True

    def validated(self) -> "SearchQuery":
        """limit/offset/length checks; each violation is an error, so no caller gets another page than asked for."""
        if self.limit < 0:
            raise ValueError("limit must be >= 0")
        if self.offset < 0:
            raise ValueError("offset must be >= 0")
        if self.limit > C.MAX_LIMIT:
            raise ValueError("limit too high")
        if self.offset > C.MAX_OFFSET:
            raise ValueError("offset too high")
        q = (self.q or "").strip() or None
        if q is not None and len(q) > C.MAX_QUERY_LENGTH:
            raise ValueError("query too long")
        for v in (self.cat, self.tag, self.sort):
            if v is not None and len(v) > C.MAX_PARAM_LENGTH:
                raise ValueError("parameter too long")
        return SearchQuery(q, self.cat, self.tag, self.sort, self.limit, self.offset,
                           self.api_key, self.has_vector)


def searchable(df: DataFrame) -> DataFrame:
    """C4: has parts and a positive size."""
    return df.where(F.col("has_parts") & (F.col("size_bytes") > 0))


def text_match(df: DataFrame, q: str) -> DataFrame:
    """Every query token present in ``search_tokens``; no tokens -> no rows."""
    toks = query_tokens(q)
    if not toks:
        return df.where(F.lit(False))
    cond = F.lit(True)
    for t in dict.fromkeys(toks):
        cond = cond & F.array_contains(F.col("search_tokens"), t)
    return df.where(cond)


def title_contains(df: DataFrame, q: str) -> DataFrame:
    """Fallback substring match (wildcards in q are not escaped)."""
    return df.where(F.col("norm_title").ilike(f"%{q}%"))


def split_categories(category: str | None) -> list[str]:
    return [c.strip() for c in (category or "").split(",") if c.strip()]


def category_in(df: DataFrame, cats: list[str]) -> DataFrame:
    """Text equality / ``= ANY`` plus a derived ``bucket IN`` predicate
    that lets Parquet partition pruning skip whole category directories."""
    if not cats:
        return df
    buckets = set()
    for c in cats:
        try:
            cid = int(c)
        except ValueError:
            cid = 7000
        buckets.add(_bucket_of(cid))
    out = df.where(F.col("category").isin(cats))
    if "bucket" in df.columns:
        out = out.where(F.col("bucket").isin(sorted(buckets)))
    return out


def _bucket_of(cid: int) -> str:
    for name, lo, hi in C.CATEGORY_BUCKETS:
        if lo <= cid <= hi:
            return name
    return C.OTHER_BUCKET


def tag_prefix(df: DataFrame, tag: str) -> DataFrame:
    """``tags LIKE 'tag%'`` — a prefix of the joined tag string."""
    return df.where(F.col("tags").startswith(tag))


def order_and_page(df: DataFrame, sort: str | None, limit: int, offset: int) -> DataFrame:
    """G1 + G2: DESC on the mapped field with NULLs first (PostgreSQL order),
    unknown sort -> date; ``(norm_title, category_id)`` makes the order total."""
    field = ORDER_MAP.get(sort or "date", "posted_at")
    ordered = df.orderBy(F.col(field).desc_nulls_first(), F.col("norm_title").asc(), F.col("category_id").asc())
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def filtered(releases: DataFrame, sq: SearchQuery) -> DataFrame:
    sq = sq.validated()
    df = searchable(releases)
    if sq.q:
        df = text_match(df, sq.q) if sq.has_vector else title_contains(df, sq.q)
    df = category_in(df, split_categories(sq.cat))
    if sq.tag:
        df = tag_prefix(df, sq.tag)
    return df


def search(releases: DataFrame, sq: SearchQuery) -> DataFrame:
    """Release rows of one result page, in rank order."""
    sq = sq.validated()
    return order_and_page(filtered(releases, sq), sq.sort, sq.limit, sq.offset)


def items(page: DataFrame, as_of: str, api_key: str | None = None) -> DataFrame:
    """Search rows -> item records (all text), skipping non-positive sizes."""
    return page.where(F.col("size_bytes") > 0).select(
        F.coalesce(F.col("norm_title"), F.lit("")).alias("title"),
        F.col("id").cast("string").alias("guid"),
        d.pub_date(F.col("posted_at"), as_of).alias("pubDate"),
        F.coalesce(F.col("category"), F.lit("")).alias("category"),
        d.item_link(F.col("id"), api_key).alias("link"),
        F.col("size_bytes").cast("string").alias("size"),
    )


# ---------------------------------------------------------------- categories

def category_dimension(spark: SparkSession, categories: DataFrame | None = None) -> DataFrame:
    """``(id, name, pos, parent)`` of the default categories, or of a
    table (id, name) such as ``sources.policies.read_categories`` gives."""
    if categories is None:
        df = spark.createDataFrame([(i, n, p) for p, (i, n) in enumerate(C.DEFAULT_CATEGORIES)], "id string, name string, pos int")
    else:
        df = categories.select("id", "name", F.col("id").try_cast("int").alias("pos"))
    return df.withColumn("parent", F.split(F.col("name"), "/").getItem(0))


def expand_categories(spark: SparkSession, ids: list[str], categories: DataFrame | None = None) -> list[str]:
    """H4 (driver-side, tiny dimension): parent id -> all ids with that parent
    name; child and unknown ids stay; first-seen order, distinct."""
    rows = C.DEFAULT_CATEGORIES if categories is None else [(r["id"], r["name"]) for r in categories.select("id", "name").collect()]
    name_of = {i: n for i, n in rows}
    children: dict[str, list[str]] = {}
    for i, n in rows:
        children.setdefault(n.split("/", 1)[0], []).append(i)
    out: list[str] = []
    for cid in ids:
        n = name_of.get(cid)
        if not n or "/" in n:
            out.append(cid)
        else:
            out.extend(children.get(n, []))
    return list(dict.fromkeys(out))


def expand_categories_df(cats: DataFrame, requests: DataFrame) -> DataFrame:
    """H4 as a join for request tables ``(req_id, ids array<string>)``:
    posexplode -> left join on parent name -> ordered distinct per request."""
    ex = requests.select("req_id", F.posexplode("ids").alias("pos", "cid"))
    names = cats.select(F.col("id").alias("cid"), F.col("name"))
    kids = cats.select(F.col("parent"), F.col("id").alias("child"), F.col("pos").alias("cpos"))
    j = ex.join(names, "cid", "left").join(
        kids, (F.col("name") == F.col("parent")) & ~F.col("name").contains("/"), "left")
    j = j.select("req_id", F.coalesce("child", "cid").alias("id"),
                 F.struct("pos", F.coalesce("cpos", F.lit(0))).alias("o"))
    first = j.groupBy("req_id", "id").agg(F.min("o").alias("o"))
    return first.groupBy("req_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "id"))), lambda s: s["id"]).alias("ids"))


def placeholder_row(page: DataFrame, as_of: str, first_cat: str = "2000", api_key: str | None = None) -> DataFrame:
    """H5: a movie query without ``q`` and without hits yields one test item
    (category = first requested id). The emptiness test is a one-row
    aggregate, so nothing is collected to the driver."""
    spark = page.sparkSession
    link = "/api?t=getnzb&id=0" + (f"&apikey={api_key}" if api_key else "")
    ph = spark.range(1).select(
        F.lit("Indexer Test Item").alias("title"), F.lit("0").alias("guid"),
        d.pub_date(F.lit(None).cast("timestamp"), as_of).alias("pubDate"),
        F.lit(first_cat).alias("category"), F.lit(link).alias("link"), F.lit("1").alias("size"))
    n = page.agg(F.count(F.lit(1)).alias("n"))
    return page.unionByName(ph.crossJoin(n).where(F.col("n") == 0).drop("n"))


# J1 with default category sets.
def _ids(parent: str) -> list[str]:
    return [i for i, n in C.DEFAULT_CATEGORIES if n.split("/", 1)[0] == parent]


def tv_ids() -> list[str]:
    return _ids("TV")


def movie_ids() -> list[str]:
    return _ids("Movies")


def audio_ids() -> list[str]:
    return _ids("Audio")


def book_ids() -> list[str]:
    return _ids("EBook")


def typed_search(releases: DataFrame, kind: str, sq: SearchQuery) -> DataFrame:
    """J2 tvsearch / J3 movie / J4 music / J5 book: J1 with default ids when
    ``cat`` is absent; the extra parameters of these modes are accepted but unused."""
    defaults = {"tv": tv_ids, "movie": movie_ids, "music": audio_ids, "book": book_ids}[kind]()
    cats = ",".join(expand_categories(releases.sparkSession, split_categories(sq.cat)) if sq.cat else defaults)
    return search(releases, SearchQuery(sq.q, cats, sq.tag, sq.sort, sq.limit, sq.offset, sq.api_key, sq.has_vector))
