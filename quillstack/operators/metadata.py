"""Typed metadata: schema defaults, required fields, suggestions, contributors; inheritance along parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.kernels import edit_distance
from quillstack.functions.lang import code
from quillstack.functions.markup import chosen, default_label, digest
from quillstack.functions.names import person
from quillstack.functions.text import de_unicode, parse_date, parse_multiline, print_multiline
from quillstack.session import discard, light, stored


def with_defaults(supplied: DataFrame, schema: DataFrame, keys: list[str]) -> DataFrame:
    """Supplied fields and the schema's, each with what it has: a full outer join."""
    return supplied.join(schema, keys, "full_outer")


def missing(schema: DataFrame, supplied: DataFrame, keys: list[str]) -> DataFrame:
    """Required fields that nothing supplies."""
    return schema.join(supplied, keys, "left_anti")


def suggestions(words: DataFrame, known: DataFrame, word: str, name: str, order: str | None = None) -> DataFrame:
    """(word, suggestion, distance): the nearest known name of each word that has one within min(3, half the name).

    Characters outside ASCII count as #; ties go to the first by `order` (the name itself if not given). Names can only
    be so near if their lengths are, so words and names are joined on the length.
    """
    keyed = known.select(F.col(name).alias("_name"), F.col(order or name).alias("_order"))
    keyed = light(keyed.withColumn("_length", F.explode(F.sequence(F.length("_name") - 3, F.length("_name") + 3))))
    pairs = words.select(word, de_unicode(F.col(word)).alias("_plain")).distinct().withColumn("_length", F.length("_plain")).join(keyed, "_length")
    pairs = pairs.withColumn("distance", edit_distance(F.col("_plain"), F.col("_name")))
    best = pairs.groupBy(word).agg(F.min(F.struct("distance", "_order", "_name")).alias("best")).select(word, F.col("best._name").alias("suggestion"), F.col("best.distance").alias("distance"))
    return best.where(F.col("distance") <= F.least(F.lit(3), F.floor(F.length("suggestion") / 2)))


def contributors(rows: DataFrame, doc: str, element: str, names: str) -> DataFrame:
    """Names split at semicolons and numbered per document and element."""
    split = rows.select(doc, element, F.posexplode(F.split(names, r"\s*;\s*")).alias("at", "name"))
    n = F.row_number().over(Window.partitionBy(doc, element).orderBy("at")).cast("long")
    return split.select(doc, element, n.alias("n"), "name")


def exit_bits(problems: DataFrame, doc: str, kind: str) -> DataFrame:
    """The bits of each document's problems, or-ed. 130 metadata, 132 body, 136 missing include."""
    bits = F.when(F.col(kind) == "meta", 130).when(F.col(kind) == "body", 132).otherwise(136)
    return problems.groupBy(doc).agg(F.bit_or(bits.cast("long")).alias("exit_code"))


#: What a field of each type is where nothing is supplied or declared. Fixed values.
TYPE_DEFAULTS = {"text": "", "rich-text": "", "bibliography": "", "boolean": "no", "date": "today", "image": "", "multiline": "", "lang": "en"}


def canonical_schema(schema: DataFrame) -> DataFrame:
    """schema(name, type, required, label, default) with what was left out: text, not required, the name with a capital, the type's default."""
    kind = F.coalesce("type", F.lit("text"))
    return schema.select(
        "name",
        kind.alias("type"),
        F.coalesce("required", F.lit(False)).alias("required"),
        F.coalesce("label", default_label(F.col("name"))).alias("label"),
        F.coalesce("default", chosen(kind, TYPE_DEFAULTS)).alias("default"),
    )


def _parsed(kind, value):
    """The value in its type's canonical form, or null where it has none."""
    return (
        F.when(kind == "boolean", F.when(F.lower(value).isin("yes", "no"), F.lower(value)))
        .when(kind == "date", F.when(F.lower(value) == "today", "today").otherwise(parse_date(value)))
        .when(kind == "lang", code(value))
        .when(kind == "multiline", print_multiline(parse_multiline(value)))
        .otherwise(value)
    )


def validated(supplied: DataFrame, schema: DataFrame, doc: str) -> DataFrame:
    """Per document its supplied fields and those of the schema that nothing supplied: (doc, name, supplied, canonical, error).

    supplied(doc, name, value) may have fields that the schema has not: those are errors, with the nearest name where one
    is near. A value that is not of its field's type is an error and the default stands in. A required field but
    title that is missing is an error. `schema` is a canonical schema.
    """
    fields = light(schema)
    documents = supplied.select(doc).distinct()
    wanted = documents.crossJoin(fields.where("name is not null"))  # documents times a schema's fixed number of fields
    unknown = supplied.join(fields, "name", "left_anti").select("name").distinct()
    near = suggestions(unknown.withColumnRenamed("name", "word"), schema.select(F.col("name").alias("known")), "word", "known")
    near = light(unknown.join(near.select(F.col("word").alias("name"), "suggestion"), "name", "left"))
    known = wanted.join(supplied, [doc, "name"], "left")
    parsed = _parsed(F.col("type"), F.col("value"))
    bad = F.col("value").isNotNull() & parsed.isNull()
    lacking = F.col("value").isNull() & F.col("required") & (F.col("name") != "title")
    error = F.when(bad, F.concat(F.lit("Not a valid "), F.col("type"), F.lit(" format"))).when(lacking, F.concat(F.lit("Missing required field '"), F.col("name"), F.lit("'")))
    checked = known.select(doc, "name", F.col("value").alias("supplied"), F.coalesce(parsed, "default").alias("canonical"), error.alias("error"))
    hint = F.when(F.col("suggestion").isNotNull(), F.concat(F.lit(" (did you mean '"), F.col("suggestion"), F.lit("'?)"))).otherwise("")
    strange = supplied.join(near, "name")
    lost = F.when(F.col("name").isin("title", "subtitle"), F.concat(F.lit("This style has no "), F.col("name"))).otherwise(F.concat(F.lit("Unexpected field '"), F.col("name"), F.lit("'"), hint))
    return checked.unionByName(strange.select(doc, "name", F.col("value").alias("supplied"), F.lit(None).cast("string").alias("canonical"), lost.alias("error")))


def raw_items(fields: DataFrame) -> DataFrame:
    """The fields as the document supplied them."""
    return fields.where("supplied is not null")


def items(fields: DataFrame) -> DataFrame:
    """The fields that have no error, or one and a value that stands in."""
    return fields.where("error is null or canonical is not null")


def has_errors(fields: DataFrame, doc: str) -> DataFrame:
    return fields.groupBy(doc).agg(F.bool_or(F.col("error").isNotNull()).alias("has_errors"))


def overridden(fields: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """The metadata of documents for which `new` has any are those of `new` alone."""
    return fields.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new)


def meta_digest(fields: DataFrame, doc: str) -> DataFrame:
    """A digest of the names of each document's items in order of name."""
    names = F.array_join(F.array_sort(F.collect_list("name")), "")
    return items(fields).groupBy(doc).agg(digest(names).alias("digest"))


#: Dublin Core element of each field, in output order, and the roles of contributors. Fixed values.
DUBLIN_CORE = {
    "title": "title", "subtitle": "title", "author": "creator", "editor": "creator", "translator": "contributor", "compilation-editor": "creator",
    "abstract": "description", "date": "date", "keywords": "subject", "publisher": "publisher", "isbn": "identifier", "uuid": "identifier",
    "copyright": "rights", "license": "rights", "lang": "language",
}
ROLES = {"author": "aut", "editor": "edt", "compilation-editor": "edc", "translator": "trl"}


def dublin_core(fields: DataFrame, doc: str) -> DataFrame:
    """(doc, ord, element, n, role, value, file_as) of fields(doc, name, value): people split and numbered within their element."""
    order = chosen(F.col("name"), {k: f"{n:02d}" for n, k in enumerate(DUBLIN_CORE)})
    rows = fields.withColumn("element", chosen(F.col("name"), DUBLIN_CORE)).where("element is not null and value != ''")
    people = F.when(F.col("name").isin(list(ROLES)), F.split("value", r"\s*;\s*")).otherwise(F.array("value"))
    each = rows.select(doc, "name", "element", order.alias("_order"), F.posexplode(people).alias("_at", "_raw"))
    role = chosen(F.col("name"), ROLES)
    parsed = each.withColumn("_person", person(F.col("_raw"))).withColumn("role", role)
    w = Window.partitionBy(doc).orderBy("_order", "_at")
    n = F.when(F.col("role").isNotNull(), F.row_number().over(Window.partitionBy(doc, "element", F.col("role").isNull()).orderBy("_order", "_at")).cast("long"))
    shown = F.when(F.col("role").isNotNull(), F.col("_person.display_name")).otherwise(F.col("_raw"))
    return parsed.select(doc, F.row_number().over(w).cast("long").alias("ord"), "element", n.alias("n"), "role", shown.alias("value"), F.when(F.col("role").isNotNull(), F.col("_person.sort_name")).alias("file_as"))


def inherited(styles: DataFrame, key: list[str], parent: str, value: str) -> DataFrame:
    """styles(key, value) with each value from the nearest ancestor that has one; null in a ring without any.

    Pointer doubling: each round looks twice as far up, and no chain is longer than the table, so the number of rounds is
    the logarithm of the rows; what is still open then goes in rings.
    """
    scope, ident = key[:-1], key[-1]
    state = stored(styles.select(*key, F.col(parent).alias("_up"), F.col(value).alias("_found")), "styles")
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where("_found is null and _up is not null").isEmpty():
            break
        above = state.select(*scope, F.col(ident).alias("_up"), F.col("_up").alias("_next"), F.col("_found").alias("_theirs"))
        joined = state.join(above, [*scope, "_up"], "left")
        open_ = F.col("_found").isNull()
        before, state = state, stored(joined.select(*key, F.when(open_, F.col("_next")).alias("_up"), F.coalesce("_found", "_theirs").alias("_found")), "styles")
        discard(before)
    return state.select(*key, F.col("_found").alias(value))
