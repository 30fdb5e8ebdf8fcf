"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.  Each is a
protected entity, named by its kind and text.  Terms are names: words with a capital beside an
entity that some text of the corpus has with a capital inside a sentence, and none in lower
case.  Over the distinct texts of all documents

    p(e | t) = n_et / n_t

is the chance to be right about an entity after reading a name, and ``-log2 p(e | t)`` the
information that is left to be told.  A name discloses an entity if the lower confidence
bound of ``p(e | t)`` (Wilson, ``z``) reaches ``bar``: at most two bits are left.  Nothing in
this depends on the size of the corpus: names that mostly stand elsewhere fall out, and
those of an entity in one text are names of that text alone.
A disclosing name is a span of kind ``term`` wherever it stands.  Equal texts count once, so
copies of one document disclose nothing by themselves.

The patterns are written without repeated groups: single separators between digits, and
dots between domain labels, are marked first, after which every pattern is a run of one
character class.  So the cost is linear and no long run can exhaust a stack.

Text is read for base spans and to count names, and once more if some disclosing name also
stands in texts without its entity; a bit table of fixed size keeps other words out of the
shuffles.  Terms are told apart by 64-bit hashes.

Defined results: a null text is empty and has no spans; rows with one id are judged one
by one; term spans never overlap base spans; extra columns pass through
:func:`sanitise` and give way to result columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .spans import let, located, replaced

KINDS = ("email", "ip", "card", "phone")
BAR, Z = 0.25, 1.645
SLOTS = 1 << 14  # of 64 bits each
RUN = 256
# Marks: one code point each, so places stay as they are.
JOINED_DIGITS, JOINED_DOT, TAKEN = "\ue000", "\ue001", "\ue002"
LOCAL = f"A-Za-z0-9._%+\\-{JOINED_DOT}"
PATTERNS = {
    "email": f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{JOINED_DOT}[A-Za-z0-9{JOINED_DOT}-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": f"[0-9][0-9{JOINED_DIGITS}]+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WORD = r"\p{L}{2,}"
CAPITAL = r"(?<!\p{L})\p{Lu}\p{L}+"
ADDRESS = r"(?<![^\s@])[^\s@]*+@\S*+"
NAME = r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+(?!\p{L})"


def each(kind: str, make) -> Column:
    """``make(span, kind)`` of every span of a kind."""
    return F.transform(kind, lambda s: make(s, F.lit(kind)))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of every kind that pass their checks."""
    plain = F.translate(text, JOINED_DIGITS + JOINED_DOT, TAKEN + TAKEN)
    mailed = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOINED_DOT)
    dealt = F.regexp_replace(plain, "(?<=[0-9])[ -](?=[0-9])", JOINED_DIGITS)
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    small = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    valid_ip = lambda s: F.forall(
        F.split(s["match"], r"\."), lambda p: (F.length(small(p)) <= 3) & (F.substring(small(p), 1, 3).cast("int") <= 255)
    )
    size = lambda s: F.length(digits(s["match"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), located(mailed, PATTERNS["email"])).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), F.filter(located(plain, PATTERNS["ip"]), valid_ip)).otherwise(none),
        "card": F.when(
            text.rlike("[0-9](?:[ -]?[0-9]){12}"),
            F.filter(F.filter(located(dealt, PATTERNS["card"]), lambda s: size(s).between(13, 19)), lambda s: luhn(digits(s["match"]))),
        ).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(located(plain, PATTERNS["phone"]), lambda s: size(s).between(9, 15))).otherwise(none),
    }


def capital_words(text: Column) -> Column:
    """``(start, end, term)`` of the words that begin with a capital; ``term`` is the hash of the word in lower case.

    Places are running sums, taken over runs of ``RUN`` words and then over runs, so the work grows
    little more than the text.
    """
    span = "array<struct<start:int,end:int,term:bigint>>"
    found = F.regexp_extract_all(text, F.lit(CAPITAL), F.lit(0))
    sized = lambda words: F.zip_with(
        F.slice(F.split(text, CAPITAL, -1), 1, F.size(words)), words,
        lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size"), F.xxhash64(F.lower(w)).alias("term")),
    )
    add = lambda s, w: F.struct(
        (s["at"] + w["gap"] + w["size"]).alias("at"),
        F.concat(s["done"], F.array(F.struct((s["at"] + w["gap"]).alias("start"), (s["at"] + w["gap"] + w["size"]).alias("end"), w["term"].alias("term")))).alias("done"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("done"))
    run = lambda words: F.aggregate(words, start, add)
    runs = lambda words: F.transform(F.sequence(F.lit(1), F.size(words), F.lit(RUN)), lambda i: run(F.slice(words, i, RUN)))
    moved = lambda s, r: F.struct(
        (s["at"] + r["at"]).alias("at"),
        F.concat(s["done"], F.array(F.transform(r["done"], lambda w: F.struct((w["start"] + s["at"]).alias("start"), (w["end"] + s["at"]).alias("end"), w["term"].alias("term"))))).alias("done"),
    )
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("done"))
    whole = let(found, lambda words: let(sized(words), lambda sizes: F.flatten(F.aggregate(runs(sizes), first, moved)["done"])))
    return F.when(text.rlike(CAPITAL), whole).otherwise(F.array().cast(span))


def read_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("h", F.xxhash64("text"))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, h, email, ip, card, phone, entities, words)``: spans by kind; entities and words with a capital of documents with spans, else null."""
    found = read_texts(docs, doc_id, text).select("doc", "text", "h", *[spans.alias(kind) for kind, spans in base_spans(F.col("text")).items()])
    all_spans = F.concat(*[each(k, lambda s, kind: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    entity = lambda s: F.concat(s["kind"], F.lit(":"), F.lower(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    found = found.withColumn("__all", all_spans).withColumn("__left", F.col("text"))
    for kind in KINDS:
        found = found.withColumn("__left", replaced(F.col("__left"), F.col(kind), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"])))
    some = F.size("__all") > 0
    return found.select(
        "doc", "h", *KINDS,
        F.when(some, F.array_distinct(F.transform("__all", entity))).alias("entities"),
        F.when(some, capital_words(F.col("__left"))).alias("words"),
    )


def mark_table(terms: DataFrame) -> Column:
    """A bit table of fixed size over the column ``term``, as a literal; other terms may share its bits."""
    bits = terms.groupBy(mark_slot(F.col("term")).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(term & 63 as int))")).alias("bits"))
    table = [0] * SLOTS
    for r in bits.collect():  # at most SLOTS rows
        table[r["slot"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def mark_slot(term: Column) -> Column:
    return F.shiftrightunsigned(term, 6).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def marked(table: Column, term: Column) -> Column:
    return F.getbit(F.get(table, mark_slot(term)), term.bitwiseAND(F.lit(63)).cast("int")) == 1


def name_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n_t)``: distinct texts that hold a name of ``terms``, whatever its case."""
    table = mark_table(terms)
    # Addresses hold names in lower case that say nothing about the word.
    text = F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", ADDRESS, " ")).otherwise(F.col("text"))
    texts = texts.select("h", text.alias("text"))
    found = lambda pattern: F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), lambda w: marked(table, F.xxhash64(F.lower(w))))
    low = lambda w: w == F.lower(w)
    hashed = lambda c: F.array_distinct(F.transform(c, lambda w: F.xxhash64(F.lower(w))))
    words = texts.select("h", found(WORD).alias("words"), found(NAME).alias("names")).where(F.size("words") > 0)
    words = words.select("h", hashed(F.filter("words", low)).alias("low"), hashed(F.filter("words", lambda w: ~low(w))).alias("high"), hashed("names").alias("names"))
    # What says that a term is a name or none needs no text: partial sums leave a row a task.
    no_text, no, yes = F.lit(None).cast("bigint").alias("h"), F.lit(False), F.lit(True)
    rows = words.select(
        F.explode(
            F.concat(
                F.transform("low", lambda t: F.struct(t.alias("term"), no_text, yes.alias("low"), no.alias("named"))),
                F.transform("names", lambda t: F.struct(t.alias("term"), no_text, no.alias("low"), yes.alias("named"))),
                F.transform(F.array_except("high", "low"), lambda t: F.struct(t.alias("term"), F.col("h"), no.alias("low"), no.alias("named"))),
            )
        ).alias("r")
    ).select("r.*")
    seen = rows.groupBy("term", "h").agg(F.max("low").alias("low"), F.max("named").alias("named"))
    seen = seen.groupBy("term").agg(F.count("h").alias("n_t"), F.max("low").alias("low"), F.max("named").alias("named"))
    return seen.where(F.col("named") & ~F.col("low")).select("term", "n_t").join(terms, "term", "left_semi")


def lower_bound(found: Column, of: Column, z: float) -> Column:
    """Wilson's lower bound of the share ``found / of``."""
    p = found / of
    return (p + z * z / (2 * of) - z * F.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def disclosing_terms(found: DataFrame, counts: DataFrame, bar: float = BAR, z: float = Z) -> DataFrame:
    """``(term, told, wide)`` of the names that tell an entity, by the hash of the name; ``wide`` ones also stand in texts without it."""
    own = found.where("entities is not null").select("h", "entities", F.array_distinct("words.term").alias("terms")).dropDuplicates(["h"])
    entities = own.select("h", F.explode("entities").alias("entity"))
    # What one meeting in two texts cannot reach takes an entity of two texts at least.
    reach = lambda k, n: (k / n + z * z / (2 * n) - z * (k / n * (1 - k / n) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
    sizes = entities.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= (1 if reach(1, 2) >= bar else 2))
    entities = entities.join(sizes, "entity")
    # The bound lies below the share, so a name is in fewer texts than this.
    most = entities.groupBy("h").agg((F.max("n_e") / F.lit(bar)).alias("most"))
    largest = entities.agg(F.max("n_e") / F.lit(bar)).first()[0] or 0.0
    terms = own.select("h", F.explode("terms").alias("term")).join(counts.where(F.col("n_t") <= max(largest, 1.0)), "term")
    # The only text of a name holds an entity: nothing is left to count.
    once = terms.where((F.col("n_t") == 1) & F.lit(reach(1, 1) >= bar)).select("term", F.lit(1.0).alias("told"), F.lit(False).alias("wide"))
    joint = terms.where("n_t > 1").join(most, "h").where("n_t <= most").join(entities, "h").groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_et"))
    joint = joint.where(lower_bound(F.col("n_et"), F.col("n_t"), z) >= bar)
    more = joint.select("term", (F.col("n_et") / F.col("n_t")).alias("told"), (F.col("n_et") < F.col("n_t")).alias("wide"))
    # A name that goes with one entity in all of its texts stands nowhere else.
    return once.unionByName(more).groupBy("term").agg(F.max("told").alias("told"), F.min("wide").alias("wide"))


def term_hits(found: DataFrame, texts: DataFrame, told: DataFrame) -> DataFrame:
    """``(doc, h, start, end, told)`` of every place of a disclosing name."""
    rows = found.where("entities is not null").select("doc", "h", "words")
    wide = told.where("wide").select("term")
    if not wide.isEmpty():
        table = mark_table(wide)
        near = F.exists(F.regexp_extract_all("text", F.lit(CAPITAL), F.lit(0)), lambda w: marked(table, F.xxhash64(F.lower(w))))
        rows = rows.unionByName(texts.where(near).select("doc", "h", F.filter(capital_words(F.col("text")), lambda w: marked(table, w["term"])).alias("words")))
    places = rows.select("doc", "h", F.explode("words").alias("w")).select("doc", "h", "w.start", "w.end", "w.term")
    return places.join(told.select("term", "told"), "term").drop("term")


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bar: float = BAR, z: float = Z) -> DataFrame:
    """``(doc, h, email, ip, card, phone, term)``: spans by kind; ``h`` is the hash of the text.

    Term spans have ``told``, the share of the name's texts that hold the entity it goes with most.
    """
    spark = docs.sparkSession
    path, to = scratch_path(spark, "personal-data"), scratch_path(spark, "disclosing-terms")
    detect(docs, doc_id, text).write.parquet(path)
    found, texts = spark.read.parquet(path), read_texts(docs, doc_id, text)
    terms = found.where("entities is not null").select(F.explode("words.term").alias("term")).distinct()
    disclosing_terms(found, name_counts(texts, terms), bar, z).write.parquet(to)
    hits = (
        term_hits(found, texts, spark.read.parquet(to))
        .groupBy("doc", "h", "start", "end").agg(F.max("told").alias("told"))
        .groupBy("doc", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "told"))).alias("term"))
        .select(F.col("doc").alias("d"), F.col("h").alias("g"), "term")
    )
    joined = found.drop("entities", "words").join(hits, F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    apart = lambda w: ~F.exists(F.concat(*[F.transform(k, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))) for k in KINDS]), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    return joined.select("doc", "h", *KINDS, F.coalesce(F.filter("term", apart), F.array().cast("array<struct<start:int,end:int,told:double>>")).alias("term"))


def span_text(kinds: tuple[str, ...] = (*KINDS, "term")) -> Column:
    """``kind:start:end`` of all spans, by kind, then start, comma-joined."""
    return F.concat_ws(",", *[each(k, lambda s, kind: F.concat_ws(":", kind, s["start"], s["end"])) for k in kinds])


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with base spans masked by kind, and disclosing terms generalised to their first letter, or removed if they tell all."""
    found = personal_spans(docs, doc_id, text, **options)
    spans = F.array_sort(
        F.concat(
            *[each(k, lambda s, kind: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(kind), F.lit("]")).alias("mask"))) for k in KINDS],
            F.transform("term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["told"] >= 1, F.lit("[TERM]")).alias("mask"))),
        )
    )
    # Spans of different kinds may overlap: the first start wins, then the first kind.
    apart = F.aggregate(
        "__spans",
        F.array().cast("array<struct<start:int,end:int,mask:string>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]), done).otherwise(F.concat(done, F.array(s))),
    )
    found = found.select(F.col("doc").alias("__d"), F.col("h").alias("__g"), spans.alias("__spans")).where(F.size("__spans") > 0)
    found = found.dropDuplicates(["__d", "__g"]).withColumn("__spans", apart)
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    joined = docs.join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col("__d")) & (F.xxhash64(own) == F.col("__g")), "left")
    masked = replaced(own, F.col("__spans"), lambda s: F.coalesce(s["mask"], F.concat(F.substring(own, s["start"] + 1, F.lit(1)), F.lit("*"))))
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(f"`{text}`")).otherwise(masked)).select(*[f"`{c}`" for c in docs.columns])
