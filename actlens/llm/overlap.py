"""Same or near-same records across splits.

Evaluation texts are cut into four disjoint word n-grams (a word is one token of the molecule string), and these are
hashed with their place. The training texts are scanned for hits: for each length and shift that three edits allow,
the n-gram at that place is hashed the same way. A pair within three edits leaves at least one of the four n-grams
untouched, so its containment (the share of the evaluation record's n-grams found in the training record) is at least
1/4: the candidate search loses nothing. An exact token edit distance then decides. Equal `canon_index` pairs come by
an equi-join.

The hashed n-grams of the evaluation side are broadcast only if their counted number is within BROADCAST_ROWS;
otherwise both sides are partitioned by the hash. Pairs of classes found are counted too and, within BROADCAST_PAIRS,
broadcast to both sides, so that only texts of such pairs are shuffled. Equal texts of a task and side are one class, named by a digest and
compared once. Numbers of pairs are counted from the sizes of classes and keys, never from pairs. Where pairs must come
out, a class or key that would give one task more than MEET pairs is cut: its training side into salted parts, with a
copy of its evaluation side for each.

Defined results: null task, split, canon_index or text equals nothing, nor does a text without any token; a null
record_id can't be reported and is left out; characters that belong to no token are skipped; repeated record ids give
one pair, and count once unless their rows differ; extra columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.common import broadcast_if, norm, settle, strip
from actlens.functions import smiles as S

EDITS = 3
PIECES = EDITS + 1
BROADCAST_ROWS = 600_000
#: Counted pairs of classes (two digests a row), or hot keys, up to which they are broadcast.
BROADCAST_PAIRS = 600_000
#: Pairs of one class or key from which it is cut into salted parts, and the most parts.
MEET, PARTS = 4_000_000, 4096
#: Words of an n-gram of the reported containment.
GRAM = 5
WORD = "\x1f"


def _letter(token: Column) -> Column:
    """The token, if it is one character, or a character chosen by hash, so that unequal tokens can only become equal, never the reverse."""
    code = F.decode(F.unhex(F.lpad(F.hex(F.lit(0x4E00) + F.pmod(F.xxhash64(token), F.lit(20480))), 4, "0")), "UTF-16BE")
    return F.when(F.length(token) == 1, token).otherwise(code)


def records(dataset: DataFrame) -> DataFrame:
    """(record_id, task, side, split, source, canon_index, text, id): side is train or eval; text is the tokens, joined; id names the class of task, side and text."""
    split = norm(F.col("split"))
    # generators of one row, behind which a value is not worked out again wherever it is used
    own = dataset.select("record_id", norm(F.col("task")).alias("task"), F.explode(F.array(split)).alias("split"), norm(F.col("source")).alias("source"), "canon_index", "smiles")
    own = own.withColumn("side", F.when(F.col("split") == "train", "train").when(F.col("split").isin("test", "valid"), "eval")).where("record_id is not null and task is not null and side is not null")
    text = F.nullif(F.array_join(S.tokens(strip(F.col("smiles"))), WORD), F.lit(""))
    own = own.select("record_id", "task", "side", "split", "source", "canon_index", F.explode(F.array(text)).alias("text"))
    return own.withColumn("id", F.when(F.col("text").isNotNull(), F.unhex(F.md5(F.concat_ws("\x1e", "side", "text", "task")))))


def _grams(classes: DataFrame) -> DataFrame:
    """(h, eval_id) of each evaluation class: its four n-grams, hashed with task, length and place."""
    piece = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))
    return classes.select("id", "task", "letters", "len", piece.alias("piece")).select(
        _hash(F.col("len"), F.col("piece"), F.expr(f"substring(letters, {_start('len')} + 1, {_width('len')})")).alias("h"), F.col("id").alias("eval_id")
    )


def _start(n: str) -> str:
    return f"cast(piece * ({n} div {PIECES}) + greatest(0, piece - {PIECES} + {n} % {PIECES}) as int)"


def _width(n: str) -> str:
    return f"cast({n} div {PIECES} + if(piece >= {PIECES} - {n} % {PIECES}, 1, 0) as int)"


def _hash(n: Column, piece: Column, gram: Column) -> Column:
    return F.xxhash64("task", n, piece, gram)


def _scan(classes: DataFrame) -> DataFrame:
    """(h, train_id) of each training class for every evaluation length, n-gram and shift that three edits allow."""
    places = [
        (d, i, off)
        for d in range(-EDITS, EDITS + 1)  # training length less evaluation length
        for i in range(PIECES)
        for off in range(max(-i, d - EDITS + i), min(i, d + EDITS - i) + 1)
    ]
    place = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for d, i, o in places))).alias("p")
    return (
        classes.select("id", "task", "letters", "len", place)
        .select("id", "task", "letters", F.col("len"), (F.col("len") - F.col("p.d")).alias("m"), F.col("p.i").alias("piece"), F.col("p.o").alias("o"))
        .where("m > 0")
        .withColumn("at", F.expr(f"{_start('m')} + o"))
        .withColumn("wide", F.expr(_width("m")))
        .where("at >= 0 and at + wide <= len")
        .select(_hash(F.col("m"), F.col("piece"), F.expr("substring(letters, at + 1, wide)")).alias("h"), F.col("id").alias("train_id"))
    )


def _exact_distance(a: Column, b: Column) -> Column:
    """Edit distance in tokens, at most EDITS, else -1: each distinct token of the pair becomes its own character."""
    words = F.array_distinct(F.concat(a, b))
    point = lambda t: F.array_position(words, t) + F.lit(0x10000)
    spell = lambda ts: F.decode(F.unhex(F.array_join(F.transform(ts, lambda t: F.lpad(F.hex(point(t)), 8, "0")), "")), "UTF-32")
    return F.levenshtein(spell(a), spell(b), EDITS)


def _distance() -> Column:
    """The token edit distance of a pair: that of the letters, unless two tokens of the pair share a letter."""
    apart = F.size(F.array_union("train_multi", "eval_multi")) == F.size(F.array_union(F.transform("train_multi", _letter), F.transform("eval_multi", _letter)))
    return F.when(apart, F.levenshtein("train_letters", "eval_letters", EDITS)).otherwise(_exact_distance(F.split("train_text", WORD), F.split("eval_text", WORD)))


def _ngrams(text: Column) -> Column:
    words = F.split(text, WORD)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - GRAM + 1)), lambda i: F.array_join(F.slice(words, i, F.lit(GRAM)), WORD)))


def near_classes(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (id, task, side, text, first, letters, len, multi), and the pairs of them within EDITS edits: (task, train_id, eval_id, train_first, eval_first, containment, distance). containment: the share of the evaluation text's GRAM-word n-grams (the whole text, if shorter) that stand in the training text."""
    classes = recs.where("text is not null").groupBy("id", "task", "side", "text").agg(F.min("record_id").alias("first"))
    classes = classes.select("*", F.explode(F.array(F.split("text", WORD))).alias("t"))
    classes = classes.select("id", "task", "side", "text", "first", "t", F.explode(F.array(F.array_join(F.transform("t", _letter), ""))).alias("letters"))
    classes = settle(classes.withColumn("len", F.length("letters")).withColumn("multi", F.array_distinct(F.filter("t", lambda t: F.length(t) > 1))).drop("t"))
    train, evals = classes.where("side = 'train'"), classes.where("side = 'eval'")
    grams = _grams(evals)
    n = PIECES * evals.count()
    found = settle(_scan(train).join(broadcast_if(grams, n, BROADCAST_ROWS), "h").select("train_id", "eval_id").distinct())
    links = broadcast_if(found, found.count(), BROADCAST_PAIRS)
    own = lambda df, side: df.select(*(F.col(c).alias(f"{side}_{c}") for c in ("id", "task", "text", "first", "letters", "multi"))).join(links, f"{side}_id")
    share = F.size(F.array_intersect(_ngrams(F.col("eval_text")), _ngrams(F.col("train_text")))) / F.size(_ngrams(F.col("eval_text")))
    near = (
        own(train, "train").join(own(evals, "eval"), ["train_id", "eval_id"])
        .where(F.col("train_task") == F.col("eval_task"))
        .where(F.levenshtein("train_letters", "eval_letters", EDITS) >= 0)
        .withColumn("distance", _distance())
        .where("distance >= 0")
        .select(F.col("train_task").alias("task"), "train_id", "eval_id", "train_first", "eval_first", share.alias("containment"), "distance")
    )
    return classes, near


def _meet(train: DataFrame, evals: DataFrame, keys: list[str], meet: int) -> DataFrame:
    """The equi-join of both on keys, where keys that give more than `meet` pairs are cut into salted parts. train and evals hold train_record and eval_record."""
    sides = train.select(*keys, F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(evals.select(*keys, F.lit(0).alias("n"), F.lit(1).alias("m")))
    pairs = F.col("n") * F.col("m")
    sizes = sides.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(pairs > meet)
    hot = settle(sizes.select(*keys, F.least(F.lit(PARTS), F.ceil(pairs / meet)).cast("int").alias("parts")))
    n = hot.count()
    if not n:
        return train.join(evals, keys)
    hot = broadcast_if(hot, n, BROADCAST_PAIRS)
    parts = F.coalesce("parts", F.lit(1))
    cut = train.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64("train_record"), parts).cast("int")).drop("parts")
    copied = evals.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return cut.join(copied, [*keys, "salt"])


def _linked(dataset: DataFrame, meet: int) -> DataFrame:
    """(train_record, eval_record), by text and by key; some pairs twice."""
    recs = settle(records(dataset))
    near = settle(near_classes(recs)[1].select("train_id", "eval_id"))  # read several times
    links = broadcast_if(near, near.count(), BROADCAST_PAIRS)
    side = lambda s: recs.where(F.col("side") == s)
    member = lambda s: side(s).where("id is not null").select(F.col("id").alias(f"{s}_id"), F.col("record_id").alias(f"{s}_record"))
    by_text = _meet(member("train").join(links, "train_id"), member("eval").join(links, "eval_id", "left_semi"), ["eval_id"], meet)
    keyed = lambda s: side(s).where("canon_index is not null").select("task", "canon_index", F.col("record_id").alias(f"{s}_record"))
    by_key = _meet(keyed("train"), keyed("eval"), ["task", "canon_index"], meet)
    return by_text.select("train_record", "eval_record").union(by_key.select("train_record", "eval_record"))


def overlaps(dataset: DataFrame, meet: int = MEET) -> DataFrame:
    """(train_record, eval_record): every pair of a training and an evaluation record of one task with the same canon_index or texts within EDITS tokens."""
    return _linked(dataset, meet).distinct()


def pairs(dataset: DataFrame, meet: int = MEET) -> DataFrame:
    """(record_a, record_b), smaller id first."""
    return _linked(dataset, meet).select(F.least("train_record", "eval_record").alias("record_a"), F.greatest("train_record", "eval_record").alias("record_b")).distinct()


def containment(dataset: DataFrame) -> DataFrame:
    """(task, train_record, eval_record, containment, distance) of each near pair of classes of equal texts, each named by its least record_id."""
    near = near_classes(settle(records(dataset)))[1]
    return near.select("task", F.col("train_first").alias("train_record"), F.col("eval_first").alias("eval_record"), "containment", "distance")


def report(dataset: DataFrame) -> DataFrame:
    """(split, source, pairs, records): overlaps per evaluation split and source; a null source is a group.

    Counted on cells of records with one class and key: those of the training side near a cell's class, plus those with
    its key, less those that are both.
    """
    recs = settle(records(dataset).distinct())
    near = near_classes(recs)[1].select("train_id", "eval_id")
    train = recs.where("side = 'train'").groupBy("task", "canon_index", "id").agg(F.count("*").alias("n"))
    cells = recs.where("side = 'eval'").groupBy("split", "source", "task", "canon_index", "id").agg(F.count("*").alias("records"))
    cells = cells.withColumnRenamed("id", "eval_id")
    own = near.join(train.withColumnRenamed("id", "train_id"), "train_id").groupBy("eval_id", F.col("canon_index").alias("key")).agg(F.sum("n").alias("n"))
    by_text = own.groupBy("eval_id").agg(F.sum("n").alias("by_text"))
    both = own.where("key is not null").select("eval_id", F.col("key").alias("canon_index"), F.col("n").alias("both"))
    by_key = train.where("canon_index is not null").groupBy("task", "canon_index").agg(F.sum("n").alias("by_key"))
    per = cells.join(by_text, "eval_id", "left").join(both, ["eval_id", "canon_index"], "left").join(by_key, ["task", "canon_index"], "left").fillna(0, ["by_text", "both", "by_key"])
    per = per.withColumn("each", F.col("by_text") + F.col("by_key") - F.col("both")).where("each > 0")
    return per.groupBy("split", "source").agg(F.sum(F.col("each") * F.col("records")).alias("pairs"), F.sum("records").alias("records"))
