"""Ranked lexical search by best positions over impact lists.

Every posting carries its *impact*, the integer its term adds to a document's score. Documents are dealt by hash to blocks
of bounded size; in a block each term has a list of its postings by falling impact, and each document a list of its own. A
query reads the lists of its terms side by side. Whenever it meets a document it looks up the document's places in
all lists directly, and each list remembers its *best position*: the end of the stretch, from the top, that has been seen
one way or the other. A document not yet met lies below every best position, so the impacts there bound its score. Reading
stops as soon as that bound is strictly below the k-th score, which leaves ties intact. Blocks pass on k rows a query at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.llm.common import small, whole_text
from edgetide.plans.ordered import row_numbers
from edgetide.session import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_POSTINGS = 500_000  # of a block of documents, on average
ITEM_BLOCK = 2048  # queries that share a pass over a block
LAST = (1 << 63) - 1
FOUND = "item_no long, rid long, doc_id long, no_id boolean, score long"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


class Lists:
    """A block's postings, by term and falling impact, and by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.terms, starts, self.line = np.unique(term[order], return_index=True, return_inverse=True)
        self.bounds = np.r_[starts, len(order)]
        self.of_doc = np.argsort(self.doc, kind="stable")  # places in the lists, document by document
        self.doc_bounds = np.searchsorted(self.doc[self.of_doc], np.arange(n_docs + 1))
        self.seen, self.scored = np.zeros(len(order), bool), np.zeros(n_docs, bool)
        self.role = np.zeros(len(self.terms), bool)

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all documents that can be among the k best, ties included."""
        at = np.searchsorted(self.terms, terms)
        lines = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        begin, size = self.bounds[lines], self.bounds[lines + 1] - self.bounds[lines]
        self.seen[:], self.scored[:], self.role[:] = False, False, False
        self.role[lines] = True
        best = np.zeros(len(lines), np.int64)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, k
        while len(lines) and (best < size).any():
            read = ragged(begin + np.minimum(depth, size), np.clip(size - depth, 0, step))
            fresh = np.unique(self.doc[read])
            fresh = fresh[~self.scored[fresh]]
            if len(fresh):
                # direct access: the places of these documents in all lists of the query
                count = self.doc_bounds[fresh + 1] - self.doc_bounds[fresh]
                places = self.of_doc[ragged(self.doc_bounds[fresh], count)]
                wanted = self.role[self.line[places]]
                self.seen[places[wanted]], self.scored[fresh] = True, True
                upto = np.r_[0, np.cumsum(np.where(wanted, self.impact[places], 0))]
                ends = np.cumsum(count)
                docs, scores = np.r_[docs, fresh], np.r_[scores, upto[ends] - upto[ends - count]]
            kth = None
            if len(scores) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                docs, scores = docs[scores >= kth], scores[scores >= kth]
            for n, (start, length) in enumerate(zip(begin, size)):
                if best[n] < length:
                    rest = self.seen[start + best[n]:start + length]
                    first = int(rest.argmin())
                    best[n] = best[n] + first if not rest[first] else length
            left = best < size
            bound = int(self.impact[begin[left] + np.maximum(best[left] - 1, 0)].sum())
            if kth is not None and bound < kth:
                break
            depth, step = depth + step, step * 2
        return docs, scores


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges [start, start + length) one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def best_in_block(items: pd.DataFrame, postings: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best documents of one block for every item."""
    rids, first, doc = np.unique(postings["rid"].to_numpy(np.int64), return_index=True, return_inverse=True)
    ids, no_id = postings["doc_id"].to_numpy(np.int64)[first], postings["no_id"].to_numpy(bool)[first]
    lists = Lists(postings["term_no"].to_numpy(np.int64), doc, postings["impact"].to_numpy(np.int64), len(rids))
    out = []
    for item_no, asked in zip(items["item_no"], items["terms"]):
        docs, scores = lists.search(np.unique(np.asarray(asked, np.int64)), k)
        order = np.lexsort((rids[docs], no_id[docs], ids[docs], -scores))[:k]
        top = docs[order]
        out.append(pd.DataFrame({"item_no": item_no, "rid": rids[top], "doc_id": ids[top], "no_id": no_id[top], "score": scores[order]}))
    return pd.concat(out, ignore_index=True)


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(rid, doc_id, n, term_no, tf) for the terms of ``vocabulary`` (term, term_no), stored.

    Every document has one more row of term 0, so its length is counted even if no term was asked for. ``rid`` names the
    row: equal ids and repeated rows are documents of their own.
    """
    split = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", terms(whole_text("text")).alias("terms"))
    sized = split.withColumn("n", F.size("terms").cast("long"))  # no filter on n here: it would split the text once more
    rows = sized.select("rid", "doc_id", "n", F.explode(F.concat(F.array(F.lit("")), F.col("terms"))).alias("term"))
    known = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([("", 0)], "term string, term_no long"))
    return stored(rows.join(small(known), "term").groupBy("rid", "doc_id", "n", "term_no").agg(F.count("*").alias("tf")))


def impacts(counts: DataFrame) -> DataFrame:
    """(rid, doc_id, no_id, term_no, impact): what each posting adds to a score; postings that add nothing are left out."""
    rows, length = counts.where("term_no = 0 and n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counts.where("term_no > 0").groupBy("term_no").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * rows + 2) / (F.col("df") * 2.0 + 1))).cast("long")
    weighted = counts.join(small(held.select("term_no", weight.alias("w"))), "term_no")
    size = F.expr(f"100 - 50 + (50 * n * {rows}L) div {max(length, 1)}L")
    scored = weighted.withColumn("m", size).withColumn("impact", F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))"))
    return scored.where("impact > 0").select(
        "rid", F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "term_no", "impact")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, block_postings: int = BLOCK_POSTINGS,
                   item_block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0.

    Equal scores go to the smaller doc_id, documents without id last. Every row of ``docs`` is a document; rows of ``items``
    with one id (or none) are one item with all their terms. Null and empty texts hold no term; items without a known term
    have no row. Other columns are ignored.
    """
    asked = items.select("item_id", F.explode(terms(whole_text("text"))).alias("term")).distinct()
    names = row_numbers(asked.select("item_id").distinct(), ["item_id"], "item_no")
    vocabulary = row_numbers(asked.select("term").distinct(), ["term"], "term_no")
    named = asked.join(names, asked["item_id"].eqNullSafe(names["item_id"])).select("item_no", "term").join(vocabulary, "term")
    counts = term_counts(docs.select("doc_id", "text"), vocabulary)
    item_blocks = max(1, -(-names.count() // item_block))
    blocks = max(1, -(-counts.count() // block_postings))
    named = stored(named.select("item_no", "term_no", F.pmod(F.xxhash64("item_no"), F.lit(item_blocks)).alias("ib")))
    wanted = named.select(F.col("ib").alias("wanted_by"), "term_no").distinct()
    lists = impacts(counts).join(small(wanted), "term_no").withColumn("dealt_to", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    queries = named.groupBy("ib", "item_no").agg(F.collect_list("term_no").alias("terms")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(questions: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(postings):
            return pd.DataFrame({"item_no": [], "rid": [], "doc_id": [], "no_id": [], "score": []}).astype("int64").astype({"no_id": bool})
        return best_in_block(questions, postings, k)

    found = queries.groupBy("ib", "block").cogroup(lists.groupBy("wanted_by", "dealt_to")).applyInPandas(meet, FOUND)
    order = Window.partitionBy("item_no").orderBy(F.col("score").desc(), "doc_id", "no_id", "rid")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    own_id = F.when(~F.col("no_id"), F.col("doc_id"))
    return best.join(names, "item_no").select("item_id", F.col("rank").cast("int").alias("rank"), own_id.alias("doc_id"), "score")


# The same result in SQL, for tables that one process can hold.
RANKED_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
s as (select count(*) as nn, sum(len(ts))::bigint as ll from d where len(ts) > 0),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
t as (select rid, doc_id, len(ts) as n, unnest(ts) as term from d),
p as (select rid, doc_id, n, term, count(*) as tf from t where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by term, nn),
r as (select item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from p join w using (term) join q using (term), s group by all)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id, rid) as rank from r where score > 0) where rank <= 50
"""
