"""Information-theoretic sanitisation (operator 9), in DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card and phone numbers.
A term can reveal an entity it occurs with: over the whole corpus, with whole
documents as events, ``log2(n(term, entity) N / (n(term) n(entity)))`` is the
information a term gives about an entity, and ``log2(N / n(entity))`` all there
is to know.  A term that gives at least ``disclosure`` of it, names the entity in
at least a share ``certainty`` of its own documents (otherwise a reader who
sees it would more often be wrong than right), and is seen with it in at least
``support`` different texts (copies are no further evidence), is generalised
like the entity itself, wherever it occurs.  Terms are words of three letters or digits or more,
hyphens and apostrophes within included, outside of entities.

Patterns scan in one direction only (no nested repetition), so very long runs
neither recurse nor backtrack.  Positions are code points.  Matches become
rows, so a document with very many of them is not held in one value.

Null text counts as empty; rows that share an id are handled each for itself;
a null id stays; an empty table gives no rows; other columns are ignored by
``personal_data`` and kept by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone", "term")  # fixed order of the spans
REPLACED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_JOINED, _OTHER = "\ue000", "\ue001"  # stand-ins of one code point
_WORD = r"\p{L}\p{N}\p{M}"
_FROM, _TO = "\ue002", "\ue003"  # around a term that is marked


def _joined(text: Column, between: str, separators: str) -> Column:
    """Single separators between two characters of a class become a stand-in."""
    return F.regexp_replace(F.translate(text, _JOINED, _OTHER), f"(?<=[{between}])[{separators}](?=[{between}])", _JOINED)


def _patterns(text: Column) -> dict[str, tuple[Column, str]]:
    """Text to search (as long as ``text``) and pattern, by kind."""
    return {
        "email": (_joined(text, _DOMAIN, "."),
                  rf"(?:(?<![{_JOINED}{_LOCAL}])|\G)[{_JOINED}{_LOCAL}]++@[{_DOMAIN}]++{_JOINED}[{_JOINED}{_DOMAIN}]*+"),
        "ip": (text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        "card": (_joined(text, "0-9", r"\x20-"), f"[0-9][0-9{_JOINED}]*+"),
        "phone": (text, r"\+[0-9][\x20().0-9-]+[0-9]"),
    }


def _matches(kind: str, searched: Column, pattern: str) -> Column:
    """Matches as (kind, index, code points since the match before, match).  The
    arrays are zipped, as a lambda would make the other one again for each match."""
    hits, gaps = F.regexp_extract_all(searched, F.lit(pattern), F.lit(0)), F.split(searched, pattern, -1)
    both = F.filter(F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"))), lambda m: m["hit"].isNotNull())
    return F.transform(both, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["hit"].alias("hit")))


def _found(text: Column) -> Column:
    """The matches of all kinds."""
    parts = []
    for kind, (searched, pattern) in _patterns(text).items():
        rows = _matches(kind, searched, pattern)
        needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))
        parts.append(F.when(needs, rows).otherwise(F.slice(rows, 1, 0)))
    return F.concat(*parts)


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, digits of the products summed; the sum ends in 0."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int"))
                         .otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    size = F.length(digits)
    ip = F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                  & (F.coalesce(F.left(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    card = F.when(size.between(14, 19), _luhn(digits)).otherwise(False)
    return (F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).otherwise(size.between(10, 15)))


def _may_hold(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("@")) | text.rlike(r"[0-9][^0-9]?[0-9]|\+[0-9]"), F.lit(False))


def _placed(found: DataFrame) -> DataFrame:
    """Start and stop of matches (row, kind, i, gap, hit)."""
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("stop", F.sum(F.col("gap") + F.length("hit")).over(upto).cast("long"))
    return placed.withColumn("start", F.col("stop") - F.length("hit"))


def base_spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, stop, value) of rows (row, text): the entities that
    pass their check."""
    placed = _placed(rows.select("row", F.explode(_found(F.col("text"))).alias("m")).select("row", "m.*"))
    # the stand-in is a dot in an address; in a number separators do not matter
    value = F.when(F.col("kind") == "email", F.lower(F.translate("hit", _JOINED, "."))).otherwise(
        F.when(F.col("kind") == "ip", F.col("hit")).otherwise(F.regexp_replace("hit", "[^0-9]", "")))
    return (placed.where(_valid(F.col("kind"), F.col("hit")))
            .select("row", "kind", "start", "stop", F.concat_ws(":", "kind", value).alias("value")))


def _replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with its merged spans replaced by ``by(span)``."""
    after = lambda i: F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
    pieces = F.transform(spans, lambda s, i: F.concat(F.substr(text, (after(i) + 1).cast("int"), (s["start"] - after(i)).cast("int")), by(s)))
    tail = F.substr(text, (F.get(spans, F.size(spans) - 1)["stop"] + 1).cast("int"))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def _words(text: Column) -> tuple[Column, Column]:
    """Terms of a text as they are spelled, and what stands between them."""
    searched = _joined(F.translate(text, _FROM + _TO, _OTHER * 2), _WORD, "'\u2019-")
    pattern = f"[{_JOINED}{_WORD}]{{3,}}+"
    return F.regexp_extract_all(searched, F.lit(pattern), F.lit(0)), F.split(searched, pattern, -1)


def _distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_words(text)[0], F.lower))


#: Frequent terms, of at most 64 letters, that are left out by a broadcast before pairs are made.
FREQUENT = 100_000
DISCLOSURE, CERTAINTY, SUPPORT = 0.6, 0.5, 3


def risky_terms(rows: DataFrame, n_value: DataFrame, disclosure: float, certainty: float, support: int) -> DataFrame:
    """(term) of rows (text, values): the terms that disclose an entity.
    ``values`` are the entities of the row that occur in ``support`` rows or
    more, ``n_value`` has in how many."""
    text = F.col("text")
    n_term = rows.select(F.explode(_distinct_terms(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n_term = stored(n_term.where(F.col("n_term") >= support), "terms")
    n = rows.count()
    most = n_value.agg(F.max("n_value")).first()[0]
    if not most:
        return n_term.select("term").limit(0)
    # n_both <= n_value, so a term that is more frequent than this discloses no entity
    limit = min(n * (most / n) ** disclosure * 1.000001, most / certainty)
    frequent = (n_term.where((F.col("n_term") > limit) & (F.length("term") <= 64)).orderBy(F.desc("n_term")).limit(FREQUENT).select("term"))
    pairs = (rows.where(F.size("values") > 0).select("values", F.xxhash64("text").alias("copy"), F.explode(_distinct_terms(text)).alias("term"))
             .join(F.broadcast(frequent), "term", "left_anti").select("term", "copy", F.explode("values").alias("value")))
    # summed in every task first, so a hot entity or term sends a row a task and text
    texts = pairs.groupBy("value", "term", "copy").agg(F.count(F.lit(1)).alias("_n"))
    together = texts.groupBy("value", "term").agg(F.sum("_n").alias("n_both"), F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= support)
    scored = stored(together, "together").join(n_term, "term").join(n_value, "value")
    gives = F.log2(F.col("n_both") * n / (F.col("n_term") * F.col("n_value")))
    scored = scored.where((gives >= disclosure * F.log2(n / F.col("n_value"))) & (F.col("n_both") >= certainty * F.col("n_term")))
    return scored.where(F.col("n_value") < n).select("term").distinct()


def term_spans(rows: DataFrame, risky: DataFrame) -> DataFrame:
    """(row, start, stop) of every occurrence of the terms in rows (row, text)."""
    text = F.col("text")
    risky = stored(risky, "risky")  # read back, so the planner knows its size
    held = rows.select("row", F.explode(_distinct_terms(text)).alias("term")).join(risky, "term")
    held = stored(held.groupBy("row").agg(F.collect_set("term").alias("terms")), "holders")
    hits, gaps = _words(text)
    mark = lambda hit: F.when(F.array_contains("terms", F.lower(hit)), F.concat(F.lit(_FROM), hit, F.lit(_TO))).otherwise(hit)
    marked = F.array_join(F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(mark(hit), F.lit("")))), "")
    marked = rows.join(held, "row").select("row", marked.alias("text"))
    found = marked.select("row", F.explode(_matches("term", F.col("text"), f"{_FROM}[^{_TO}]*+{_TO}")).alias("m"))
    found = found.select("row", "m.*").withColumn("hit", F.translate("hit", _FROM + _TO, ""))
    return _placed(found).select("row", "start", "stop")


def _new_name(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def _listed(spans: DataFrame) -> DataFrame:
    """Per row its spans in order: by start, then kind as listed."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "stop", "kind"))).alias("spans"))


def _merged(spans: Column) -> Column:
    """Spans that overlap as one, of the kind of the first."""
    begin = F.struct(F.array().cast("array<struct<start:bigint,stop:bigint,kind:string>>").alias("out"), F.lit(0).cast("long").alias("end"))

    def merge(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["end"]
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(s["stop"], last["stop"]).alias("stop"), last["kind"].alias("kind"))
        return F.struct(
            F.when(apart, F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))))
            .when(s["stop"] > acc["end"], F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(grown)))
            .otherwise(acc["out"]).alias("out"), F.greatest(s["stop"], acc["end"]).alias("end"))

    return F.aggregate(spans, begin, merge)["out"]


def all_spans(docs: DataFrame, row: str, disclosure: float, certainty: float, support: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a row number in the new column ``row``, and the spans
    (row, kind, start, stop) of all rows.  Texts that can hold no entity are not
    shuffled; the others meet the table of their spans."""
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col(row).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    may = _may_hold(F.col("text"))
    spans = stored(base_spans(own.where(may)), "spans")
    values = spans.select("row", "value").distinct()
    n_value = stored(values.groupBy("value").agg(F.count(F.lit(1)).alias("n_value")).where(F.col("n_value") >= support), "values")
    shared = values.join(n_value, "value", "left_semi").groupBy("row").agg(F.collect_list("value").alias("values"))
    # entities are blanked: a word that overlaps one is part of it
    blank = lambda s: F.repeat(F.lit(" "), (s["stop"] - s["start"]).cast("int"))
    about = stored(_listed(spans).select("row", _merged(F.col("spans")).alias("spans")).join(shared, "row", "left"), "about")
    marked = own.where(may).join(about, "row", "left").select("row", _replaced(F.col("text"), F.col("spans"), blank).alias("text"), "values")
    masked = own.where(~may).withColumn("values", F.lit(None).cast("array<string>")).unionByName(marked)
    terms = stored(term_spans(masked.select("row", "text"), risky_terms(masked, n_value, disclosure, certainty, support)), "marked")
    return rows, spans.select("row", "kind", "start", "stop").unionByName(terms.withColumn("kind", F.lit("term")).select("row", "kind", "start", "stop"))


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, certainty: float = CERTAINTY, support: int = SUPPORT) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held, spans = all_spans(docs, "row", disclosure, certainty, support)
    rows = held.select("row", "doc_id").join(stored(_listed(spans), "listed"), "row", "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,stop:bigint,kind:string>>")))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "term"), text), ",")
    return rows.select("doc_id", *map(n, KINDS[:4]), F.sha2(base, 256).alias("base_sha256"),
                       F.array_join(F.transform("spans", text), ",").alias("spans"), n("term"))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, certainty: float = CERTAINTY, support: int = SUPPORT) -> DataFrame:
    """``docs`` with personal data and revealing terms replaced by their kind in
    brackets; all columns and rows stay.  Overlapping spans are replaced as one,
    by the kind of the first."""
    row, spans_of = _new_name("_row", docs.columns), _new_name("_spans", docs.columns)
    held, spans = all_spans(docs, row, disclosure, certainty, support)
    listed = stored(_listed(spans).select(F.col("row").alias(row), _merged(F.col("spans")).alias(spans_of)), "listed")
    label = F.create_map(*[F.lit(x) for pair in REPLACED.items() for x in pair])
    cleaned = _replaced(F.col("text"), F.col(spans_of), lambda s: F.element_at(label, s["kind"]))
    return held.join(listed, row, "left").withColumn("text", cleaned).select(docs.columns)
