"""Search for terms within texts by postings of letter runs with their places: no text is read.

Every place of a text has a run of SIZE letters, filled up with END behind the text. A term stands at a place if its runs,
laid side by side, and the last one, stand at theirs. The postings of a term's rarest run give the places that are
looked at; the others only confirm them. A term shorter than a run is looked up among the distinct runs by its letters.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

SIZE, END = 3, "\x03"


def postings(rows: DataFrame, id_column: str, text_column: str, size: int = SIZE) -> DataFrame:
    """gram, id, places: each run of a text once, with its places from 0 on, in order. Rows of null texts or ids have none.

    A text's runs are gathered where the text is, so that its places aren't moved one by one."""
    texts = rows.filter(F.col(id_column).isNotNull() & (F.length(text_column) > 0)).select(F.col(id_column).alias("id"), F.col(text_column).alias("body"))
    filled = END * (size - 1)

    def run(batches):
        for batch in batches:
            for k, body in enumerate(batch.column("body").to_pylist()):
                places: dict[str, list[int]] = {}
                whole = body + filled
                for at in range(len(body)):
                    places.setdefault(whole[at : at + size], []).append(at)
                ids = batch.column("id").take(pa.array([k] * len(places), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(places.keys(), pa.string()), ids, pa.array(places.values(), pa.list_(pa.int32()))], ["gram", "id", "places"])

    return texts.mapInArrow(run, f"gram string, id {texts.schema['id'].dataType.simpleString()}, places array<int>")


def _runs(terms: DataFrame, grams: DataFrame, size: int) -> DataFrame:
    """term, gram, offset: the runs that a term consists of; of a shorter term every run that begins with it, as offset 0."""
    m = F.length("term")
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), m - size, F.lit(size)), F.array(m - size)))
    whole = terms.filter(m >= size).select("term", F.explode(offsets).alias("offset")).select("term", F.substring(F.col("term"), F.col("offset") + 1, F.lit(size)).alias("gram"), "offset")
    for n in range(1, size):
        begun = grams.select(F.substring("gram", 1, n).alias("term"), "gram")
        whole = whole.unionByName(terms.filter(m == n).join(begun, "term").select("term", "gram", F.lit(0).alias("offset")))
    return whole


def containing(index: DataFrame, terms: DataFrame, size: int = SIZE) -> DataFrame:
    """term, id of every text that holds a term (column term, not empty), from postings that are cheap to read again."""
    own = cut(terms.select("term").filter("term <> ''").distinct(), "terms")
    often = cut(index.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "often")
    runs = cut(_runs(own, often, size).join(often, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))), "runs")
    short = F.length("term") < size
    rarest = Window.partitionBy("term").orderBy("df", "offset")
    ranked = runs.filter(~short).withColumns({"nth": F.row_number().over(rarest), "n": F.count(F.lit(1)).over(Window.partitionBy("term")), "least": F.min("df").over(Window.partitionBy("term"))})
    ranked = ranked.filter("least > 0")  # a run that no text has
    # The texts that hold a term's rarest run; the others are looked up in those only.
    shifted = F.transform("places", lambda p: p - F.col("offset")).alias("starts")
    first = cut(ranked.filter("nth = 1").join(index, "gram").select("term", "n", "id", shifted), "first")
    rest = first.filter("n > 1").select("term", "n", "id").join(ranked.filter("nth > 1").select("term", "gram", "offset"), "term")
    rest = rest.join(index, ["gram", "id"]).select("term", "n", "id", shifted)
    met = first.filter("n > 1").unionByName(rest).groupBy("term", "n", "id").agg(F.collect_list("starts").alias("l")).filter(F.size("l") == F.col("n"))
    both = F.aggregate(F.slice("l", 2, F.col("n").cast("int") - 1), F.get("l", F.lit(0)), F.array_intersect)
    more = met.filter(F.size(both) > 0)
    whole = first.filter("n = 1").select("term", "id").unionByName(more.select("term", "id"))
    brief = runs.filter(short).select("term", "gram").join(index.select("gram", "id"), "gram").select("term", "id")
    return whole.unionByName(brief).distinct()


def matching(index: DataFrame, groups: DataFrame, size: int = SIZE) -> DataFrame:
    """query_id, id of the texts that hold a term of every group of a query. groups: query_id, part, term; a group without a term that
    isn't empty can't be met."""
    return met(groups, containing(index, groups, size))


def met(groups: DataFrame, held: DataFrame) -> DataFrame:
    """query_id, id of the texts that hold a term of every group. held: term, id of every text that holds a term.

    What texts hold is dealt by text, so that a query's groups are counted where they are."""
    wanted = groups.groupBy("query_id").agg(F.countDistinct("part").alias("n"))
    named = groups.select("query_id", "part", "term").distinct()
    hits = held.repartition("id").join(named, "term").groupBy("query_id", "id").agg(F.countDistinct("part").alias("met"))
    return hits.join(wanted, "query_id").filter("met = n").select("query_id", "id")
