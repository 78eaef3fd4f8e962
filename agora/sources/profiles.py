"""Profiles of office holders, read from official pages by an explicit specification of each.

A specification says whom it expects and where: by selectors in HTML, in HTML that a JSON text carries, or in a JSON list.
Reading never guesses: whatever differs from the specification is one of eight outcomes, and only ``success`` makes a candidate.

    success                       the expected name stands once where it should, with its context
    markup_changed                a selector finds none or several elements, or the caption is not that of the context's table
    identity_changed              another name, or no row of that name in a list
    ambiguous_identity            several rows of that name in a list
    role_changed                  the row of that name has another position
    name_surface_review_required  the name only stands inside of other letters
    attribute_review_required     the name is an attribute, or the context does not repeat it
    failed                        no body, no JSON, or no such path in it
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.forms import spaced_name
from . import pages, selectors
from .landing import folder, landed

LIST_ROWS, CAPTION = 2000, 300
_NAME = re.compile(r"[A-Za-z0-9_-]{1,128}")
_FIELD = re.compile(r"[A-Za-z0-9_-]{1,100}")
_CONTACT_FIELD = re.compile("TEL|FAX|PHONE|EMAIL|MAIL|ADDR|CONTACT", re.IGNORECASE)


@dataclass(frozen=True)
class Profile:
    """Where an official page names the holder of an office.

    Either ``name_selector`` and ``context_selector`` (with ``json_text_path``, in the HTML of that JSON text; with
    ``caption_selector``, in a table of that caption; with ``name_attribute``, in an attribute; with ``name_template``, in words
    around the name), or ``json_list_path`` with the fields of name and position.
    """

    spec: str
    url: str
    expected_name: str
    position: str
    name_selector: str | None = None
    context_selector: str | None = None
    caption_selector: str | None = None
    name_attribute: str | None = None
    name_template: str | None = None
    json_text_path: tuple[str, ...] | None = None
    json_list_path: tuple[str, ...] | None = None
    json_name_field: str | None = None
    json_position_field: str | None = None
    source_record_id: str | None = None

    def __post_init__(self) -> None:
        if not _NAME.fullmatch(self.spec):
            raise ValueError("invalid specification id")
        if not (0 < len(self.expected_name) <= 4000 and 0 < len(self.position) <= 4000):
            raise ValueError("a profile needs an expected name and a position")
        for path in (self.json_text_path, self.json_list_path):
            if path is not None and not (1 <= len(path) <= 4 and all(_FIELD.fullmatch(k) for k in path)):
                raise ValueError("a JSON path has one to four plain keys")
        if self.json_list_path is not None:
            if any(x is not None for x in (self.name_selector, self.context_selector, self.caption_selector, self.name_attribute, self.name_template, self.json_text_path)):
                raise ValueError("a JSON list is read without selectors")
            fields = (self.json_name_field, self.json_position_field)
            if any(f is None or not _FIELD.fullmatch(f) or _CONTACT_FIELD.search(f) for f in fields) or fields[0] == fields[1]:
                raise ValueError("a JSON list needs two different fields, none of contact data")
        else:
            if not (self.name_selector and self.context_selector):
                raise ValueError("a page needs selectors of name and context")
            for selector in (self.name_selector, self.context_selector, self.caption_selector):
                if selector is not None:
                    selectors.steps(selector)
        if self.name_attribute not in (None, "alt", "title"):
            raise ValueError("a name is read from alt or title only")
        t = self.name_template
        if t is not None and (not 0 < len(t) <= 200 or t.count("{name}") != 1 or t.count("{") != 1 or t.count("}") != 1 or self.position not in t):
            raise ValueError("a template has the position and {name} once")


def table(spark: SparkSession, profiles: Iterable[Profile]) -> DataFrame:
    """A row per profile; ids must be different."""
    rows = [asdict(p) for p in profiles]
    if len({r["spec"] for r in rows}) < len(rows):
        raise ValueError("repeated specification id")
    path = lambda keys: None if keys is None else "$." + ".".join(keys)
    rows = [r | {"json_text_path": path(r["json_text_path"]), "json_list_path": path(r["json_list_path"])} for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"{name} string" for name in Profile.__dataclass_fields__))


def _times(text: Column, phrase: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)


def _listed(df: DataFrame) -> DataFrame:
    """Status, surface, context and locator of pages read by a JSON list."""
    rows = F.expr("from_json(get_json_object(body, json_list_path), 'array<string>')")
    df = df.withColumn("__rows", F.when(F.expr("get_json_object(body, json_list_path)").rlike(r"^\s*\["), rows))
    name = "get_json_object(r, concat('$.', json_name_field))"
    df = df.withColumn("__at", F.expr(f"filter(transform(__rows, (r, i) -> if({name} = expected_name, i, null)), i -> i is not null)"))
    df = df.withColumn("__role", F.expr("get_json_object(get(__rows, get(__at, 0)), concat('$.', json_position_field))"))
    broken = F.col("__rows").isNull() | (F.size("__rows") > LIST_ROWS)
    status = F.when(broken, "failed").when(F.size("__at") == 0, "identity_changed").when(F.size("__at") > 1, "ambiguous_identity").when(~F.col("__role").eqNullSafe(F.col("position")), "role_changed").otherwise("success")
    locator = F.concat(F.lit("JSON "), "json_list_path", F.lit("["), F.get("__at", F.lit(0)), F.lit("] fields "), "json_name_field", F.lit(","), "json_position_field")
    return df.withColumns({"status": status, "surface": F.col("expected_name"), "context": F.concat_ws(" ", "expected_name", "position"), "locator": locator, "format": F.lit("json")})


def _selected(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same of pages read by selectors."""
    spark = df.sparkSession
    df = df.withColumn("__html", F.when(F.col("json_text_path").isNull(), F.col("body")).otherwise(F.expr("get_json_object(body, json_text_path)")))
    tree = landed(pages.elements(df, keys, "__html", above=("table",), texts=True), f"{folder(spark, 'profiles')}/tree")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_selector").alias("selector")) for f in ("name", "context", "caption")])
    asked = df.select("spec", F.explode(fields).alias("f")).select("spec", "f.*").where("selector IS NOT NULL").distinct()
    # A row per specification, of which there are few.
    used = selectors.table(spark, [r.selector for r in asked.select("selector").distinct().collect()])
    found = selectors.select(tree, keys, asked, used)
    counts = found.groupBy(*keys).agg(*[F.count_if(F.col("field") == f).alias(f"n_{f}") for f in ("name", "context", "caption")])
    once = found.join(counts, keys).where("n_name = 1 AND n_context = 1 AND n_caption <= 1").select(found["*"])
    said = selectors.texts_of(once, tree, keys)
    of = lambda field, value: F.max(F.when(F.col("field") == field, value))
    attributes = F.when(F.col("field") == "name", F.col("attributes"))
    met = said.groupBy(*keys).agg(
        of("name", F.col("content")).alias("__name"), of("context", F.col("content")).alias("__context"), of("caption", F.col("content")).alias("__caption"),
        of("context", F.col("above")["table"]).alias("__table"), of("caption", F.col("parent")).alias("__of"), F.max(attributes["alt"]).alias("__alt"), F.max(attributes["title"]).alias("__title"),
    )
    df = df.join(counts, keys, "left").join(met, keys, "left")
    count = lambda f: F.coalesce(F.col(f"n_{f}"), F.lit(0))
    captioned = F.col("caption_selector").isNotNull()
    good = (count("caption") == 1) & F.col("__table").isNotNull() & (F.col("__table") == F.col("__of")) & F.length("__caption").between(1, CAPTION)
    changed = (count("name") != 1) | (count("context") != 1) | (captioned & ~F.coalesce(good, F.lit(False)))
    by_attribute = F.col("name_attribute").isNotNull()
    text = F.when(F.col("name_attribute") == "alt", F.coalesce("__alt", F.lit(""))).when(F.col("name_attribute") == "title", F.coalesce("__title", F.lit(""))).otherwise(F.col("__name"))
    context = F.when(captioned, F.concat_ws(" ", "__caption", "__context")).otherwise(F.col("__context"))
    name, phrase = F.col("expected_name"), F.replace("name_template", F.lit("{name}"), F.col("expected_name"))
    surface = lambda t: F.when(phrase.isNull(), F.nullif(spaced_name(t, name), F.lit(""))).when(_times(t, phrase) == 1, name)
    bare = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    unseen = F.when(bare(text).contains(bare(name)), "name_surface_review_required").otherwise("identity_changed")
    status = F.when(F.col("__html").isNull(), "failed").when(changed, "markup_changed").when(surface(text).isNull(), unseen).when(by_attribute | surface(context).isNull(), "attribute_review_required").otherwise("success")
    prefix = F.when(F.col("json_text_path").isNull(), "html:").otherwise(F.concat(F.lit("json:/"), F.replace(F.substring("json_text_path", 3, 999), F.lit("."), F.lit("/")), F.lit("|html:")))
    locator = F.concat(prefix, F.when(captioned, F.concat("caption_selector", F.lit(" + "), "context_selector")).otherwise(F.col("context_selector")))
    return df.withColumns({"status": status, "surface": surface(context), "context": context, "locator": locator, "format": F.when(F.col("json_text_path").isNull(), "html").otherwise("json")})


def observe(read: DataFrame, profiles: DataFrame, key: str = "page") -> DataFrame:
    """(key, spec, status, name, position, surface, context, locator, format, record_id) of ``read`` (key, spec, body).

    Each row of ``read`` is one observation of the page of one profile; its key is unique.  A null body is one that was not
    answered.  What makes a candidate is null unless the status is success.  Observations of no profile have no row.
    Equal bodies of one specification are read once.
    """
    digest = F.coalesce(F.sha2("body", 256), F.lit(""))  # no digest is empty
    seen = read.select(F.col(key).alias("__seen"), "spec", "body").join(profiles.select("spec"), "spec")
    different = seen.select("spec", "body").distinct().select(digest.alias("__key"), "spec", "body")
    df = landed(different, f"{folder(read.sparkSession, 'profiles')}/different").join(profiles, "spec")
    keys = ["__key", "spec"]
    listed = _listed(df.where("json_list_path IS NOT NULL"))
    selected = _selected(df.where("json_list_path IS NULL"), keys)
    provisional = F.concat(F.lit("provisional-profile:"), F.sha2(F.concat("url", F.lit("\0"), "position", F.lit("\0"), "expected_name"), 256))
    won = F.col("status") == "success"
    made = {"surface": F.col("surface"), "context": F.col("context"), "locator": F.col("locator"), "format": F.col("format"), "record_id": F.coalesce("source_record_id", provisional)}
    both = [d.withColumn("record_id", F.lit(None).cast("string")).select(*keys, "status", F.col("expected_name").alias("name"), "position", *[F.when(won, v).alias(n) for n, v in made.items()]) for d in (listed, selected)]
    found = landed(both[0].unionByName(both[1]), f"{folder(read.sparkSession, 'profiles')}/found")
    return seen.select("__seen", "spec", digest.alias("__key")).join(found, keys).drop("__key").withColumnRenamed("__seen", key).select(key, "spec", "status", "name", "position", *made)
