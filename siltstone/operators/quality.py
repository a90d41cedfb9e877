"""Contamination, duplicates, validity cascades and filters of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import small

#: Held-out n-grams that are broadcast at most, at 24 bytes each; beyond that the runs are shuffled.
HELD_GRAMS = 2_000_000


def contamination(records: DataFrame, held: DataFrame, n: int = 8, above: float = 0.10) -> DataFrame:
    """doc_id, grams, shared, contained, contaminated: share of a record's word n-grams that held-out texts have.

    Records of fewer than n words have no n-grams and are never contaminated.
    """
    def grams(text):
        ws = F.filter(F.split(T.key(text), " "), lambda w: w != "")

        def runs(a):
            found = F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice(a, i, n), " ")))
            return F.when(F.size(a) >= n, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

        return T.bound(ws, runs)

    # 64-bit hashes of the runs meet the held-out ones on the spot; what is shuffled is a count or two for each record.
    known = small(held.select(F.explode(grams(F.col("text"))).alias("gram")).distinct().withColumn("known", F.lit(1)), HELD_GRAMS)
    mine = records.select("doc_id", F.explode_outer(grams(F.col("text"))).alias("gram")).join(known, "gram", "left")
    out = mine.groupBy("doc_id").agg(F.count("gram").alias("grams"), F.count("known").alias("shared"))
    share = F.when(F.col("grams") > 0, F.round(F.col("shared") / F.col("grams"), 6)).otherwise(0.0)
    return out.select("doc_id", "grams", "shared", share.alias("contained"), (share > above).alias("contaminated"))


def distinct_answers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each distinct trimmed text, and the map from rows to it."""
    hashed = rows.select("doc_id", "source", T.short_id(F.trim("text")).alias("answer_id"))
    first = hashed.groupBy("answer_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("uses"))
    return first, hashed


def first_match(reasons: list[tuple[str, Column]], default: str) -> Column:
    """The first reason whose condition holds; unknown conditions don't hold."""
    out = F.lit(default)
    for name, holds in reversed(reasons):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def reasons_of(rules: list[tuple[str, Column]]) -> Column:
    """All reasons whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules]))


def accepted_once(entries: DataFrame, valid: Column, key: str, order: str) -> DataFrame:
    """Valid entries, the first of each key: an entry that isn't valid doesn't reserve its key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return entries.where(valid).withColumn("_n", rank).where("_n = 1").drop("_n")


def exclusions(record_start, record_end, query_start, query_end, record_entities, query_entities, record_aspects, query_aspects, n_words, least_words, record_intent=None, query_intent=None) -> Column:
    """Why a stored text can't answer a query.  What a record doesn't state isn't satisfied."""
    def missing(wanted, there):
        return F.size(F.array_except(F.transform(wanted, T.key), F.transform(F.coalesce(there, F.array().cast("array<string>")), T.key))) > 0

    period = ~(record_start.eqNullSafe(query_start) & record_end.eqNullSafe(query_end)) & query_start.isNotNull()
    asked = F.lit(None).cast("string") if query_intent is None else query_intent
    offered = F.lit(None).cast("string") if record_intent is None else record_intent
    intent = asked.isNotNull() & ~T.key(asked).eqNullSafe(T.key(offered))
    return reasons_of([("period", period), ("intent", intent), ("entities", missing(query_entities, record_entities)), ("aspects", missing(query_aspects, record_aspects)), ("too_short", n_words < least_words)])


# Bibliographic lines, image marks, addresses and page references, which must not become clues; how sources are headed and cited.
REFERENCE_LINE = r"(?i)^\s*(?:na podstawie:|\[obraz:)|https?://|www\.|\b[A-Za-z0-9_]+\.(?:pl|org|com)\b|\bs\.\s*[0-9]"
SOURCE_HEAD = r"(?im)^\s*[Źź]r[Óó]d[Łł]o\s+([0-9]+)\."
SOURCE_CITED = r"(?i)[Źź]r[Óó]d(?:[Łł]o|[Łł]a|le)\s+([0-9]+)"
# Furniture of answer sheets and of printed papers, as whole lines or as what lines begin with.
SHEET = {"whole": (r"[. …•_]+", r"Uzasadnienie:(?: …)?"), "begins": (), "dots": r"[. …_]{4,}"}
PAPER = {"whole": (r"Strona [0-9]+ z [0-9]+", r"[0-9]+(?:\.[0-9]+)?\.", r"0[–-][0-9]+(?:[–-][0-9]+)*"), "begins": ("Więcej arkuszy", "MHIP-"), "dots": None}


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n|\f")


def question_source(prompt: Column, source: Column) -> Column:
    """text, cited of a question: of its numbered sources those that the prompt cites, if all of them are there, else all that there is (and none cited); without reference lines."""
    ids = F.regexp_extract_all(source, F.lit(SOURCE_HEAD), 1)
    bodies = F.slice(F.split(source, SOURCE_HEAD), F.lit(2), F.size(ids))
    cited = F.array_sort(F.array_distinct(F.regexp_extract_all(prompt, F.lit(SOURCE_CITED), 1)))
    blocks = F.zip_with(ids, bodies, lambda i, b: F.struct(i.alias("id"), b.alias("body")))

    def chosen(all_: Column) -> Column:
        # Of a number that is given twice the last text counts, at the place of the first.
        last = F.transform(F.array_distinct(F.transform(all_, lambda x: x["id"])), lambda i: F.try_element_at(F.filter(all_, lambda x: x["id"] == i), F.lit(-1)))
        return F.array_join(F.transform(F.filter(last, lambda x: F.array_contains(cited, x["id"])), lambda x: x["body"]), "\n")

    known = (F.size(cited) > 0) & (F.size(F.array_except(cited, ids)) == 0)
    text = F.when(known, T.bound(blocks, chosen)).otherwise(source)
    kept = F.array_join(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: ~x.rlike(REFERENCE_LINE)), "\n")
    return F.struct(kept.alias("text"), F.when(known, cited).otherwise(F.array().cast("array<string>")).alias("cited"))


def without_furniture(text: Column, rule: dict) -> Column:
    """Stripped lines that aren't empty and aren't the furniture of a rule (SHEET or PAPER); runs of dots become one mark where the rule says so."""
    bare = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    dotted = F.transform(bare, lambda x: F.regexp_replace(x, rule["dots"], " …")) if rule["dots"] else bare
    whole = "^(?:" + "|".join(rule["whole"]) + ")$"

    def stays(raw: Column, x: Column) -> Column:
        keep = (raw != "") & ~raw.rlike(whole) & ~x.rlike(whole)
        for start in rule["begins"]:
            keep = keep & ~x.startswith(start)
        return keep

    both = F.zip_with(bare, dotted, lambda raw, x: F.when(stays(raw, x), x))
    return F.array_join(F.array_compact(both), "\n")


def article_reasons(missing: Column, disambiguation: Column, text: Column, least: int = 150) -> Column:
    """Why a fetched article isn't used: it isn't there, lists other articles, or has too little text."""
    bare = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    return reasons_of([("missing", F.coalesce(missing, F.lit(False))), ("disambiguation", F.coalesce(disambiguation, F.lit(False))), ("too_short", bare < least)])


def bank_entry(entry_id: Column, n_words: Column, topics: Column, least: int = 320) -> Column:
    """Whether a bank may take an entry: an id, enough words, and a topic at least."""
    return F.coalesce((entry_id.cast("string") != "") & (n_words >= least) & (F.size(topics) > 0), F.lit(False))


# Line furniture in scanned papers and on web pages.
FURNITURE = (r"^\s*[0-9]{1,3}\s*$", r"^\s*[.…_-]{5,}\s*$", r"^\s*(?:strona|page)\s+[0-9]+", r"^\s*https?://\S+\s*$")


def clean_lines(text: Column, furniture=FURNITURE) -> Column:
    def stays(line):
        keep = F.lit(True)
        for pattern in furniture:
            keep = keep & ~line.rlike("(?i)" + pattern)
        return keep

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def item_kind(points: Column, prompt: Column, essay_start: str = "Jeden tekst", open_start: str = "Tekst") -> Column:
    """essay: ten points or more, or its stock phrase; open: its stock phrase; else closed."""
    return F.when((points >= 10) | prompt.startswith(essay_start), "essay").when(prompt.startswith(open_start), "open").otherwise("closed")


def finite_positive(x: Column) -> Column:
    return F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))


def safe_path(path: Column) -> Column:
    """Relative, without parent steps or backslashes."""
    return F.coalesce((path != "") & ~path.rlike(r"(^/|(^|/)\.\.(/|$)|\\)"), F.lit(False))


def in_scope(url: Column, hosts: tuple[str, ...], prefix: str) -> Column:
    """https, an exact host, no user, a path prefix, and no query but start=<digits>."""
    host = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.coalesce(host.isin(*hosts) & path.startswith(prefix) & ((query == "") | query.rlike("^start=[0-9]+$")), F.lit(False))


def endpoint_allowed(url: Column) -> Column:
    """https, or http on this machine only; no user, query or fragment."""
    place = F.regexp_extract(url, r"^(?:https?)://([^/?#]*)", 1)
    secure = url.startswith("https://") | (url.startswith("http://") & place.rlike(r"^(localhost|127\.0\.0\.1)(:[0-9]+)?$"))
    return F.coalesce(secure & (place != "") & ~F.contains(place, F.lit("@")) & ~url.rlike("[?#]"), F.lit(False))


# Names of fields that only graders may see.
GRADING_FIELDS = ("expected", "accepted", "gold", "gold_answer", "answer_key", "rubric", "rubric_and_examples", "correct_answer", "solution")


def all_keys(json: Column) -> Column:
    """The names of fields in a JSON text, at any depth and within lists too, as often as they occur.

    The text is read as its strings, one after the other, so that nothing inside a string is taken
    for a name: a name is a string with a colon behind it.  Escapes are resolved.  Null for what is no JSON.
    """
    string = r'"(?:[^"\\]++|\\.)*+"'
    found = F.filter(F.regexp_extract_all(json, F.lit(string + r"\s*:?"), 0), lambda x: x.endswith(":"))
    names = F.transform(found, lambda x: F.get(F.from_json(F.concat(F.lit("["), F.regexp_replace(x, r"\s*:$", ""), F.lit("]")), "array<string>"), 0))
    return F.when(T.parsed_json(json).isNotNull(), names)


def leaked_fields(props: Column, forbidden: tuple[str, ...] = GRADING_FIELDS) -> Column:
    """The forbidden names among all field names of a JSON text, sorted; none for a null or what is no JSON."""
    found = F.array_intersect(F.coalesce(all_keys(props), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in forbidden]))
    return F.array_sort(F.array_distinct(found))


def cited_blocks(prompt: Column, numbers: Column, mark: str = r"src\s+([0-9]+)") -> Column:
    """Block numbers to keep: those the prompt cites if all of them exist, else all."""
    cited = F.array_distinct(F.regexp_extract_all(F.lower(prompt), F.lit(mark), 1))
    return F.when((F.size(cited) > 0) & (F.size(F.array_except(cited, numbers)) == 0), F.filter(numbers, lambda n: F.array_contains(cited, n))).otherwise(numbers)
