"""Text and fields of raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import terms
from rolesift.functions import text as X

VISIBLE = "_visible"


def page_text(pages: DataFrame) -> DataFrame:
    """Adds ``text``: the whole page without markup."""
    return pages.withColumn("text", X.plain_text(F.col("html")))


def _element(name: str) -> Column:
    """The text of the first element of that name."""
    end = rf"</(?i:{name})[\s/>]"
    inner = rf"<(?i:{name})(?=[\s/>])[^>]*(?:>((?s:.*?))(?:{end}|\z)|\z)"
    return X.plain_text(F.regexp_extract(F.col(VISIBLE), inner, 1))


def _fields() -> dict[str, Column]:
    lang = F.regexp_extract(
        F.col(VISIBLE), r"""<(?i:html)(?:\s[^<>]*?)?\s(?i:lang)\s*=\s*["']?([A-Za-z0-9-]+)""", 1
    )
    host = F.regexp_extract(
        F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1
    )
    return {
        "title": _element("title"),
        "h1": _element("h1"),
        "lang": F.lower(lang),
        "host": F.lower(F.coalesce(host, F.lit(""))),
    }


def page_fields(pages: DataFrame) -> DataFrame:
    """Adds ``title``, ``h1``, ``lang`` and ``host``; empty where absent."""
    visible = pages.withColumn(VISIBLE, X.without_invisible(F.col("html")))
    return visible.withColumns(_fields()).drop(VISIBLE)


# A label and its mark, or a label that is an element of its own; then, perhaps in
# the next element, the place, up to a delimiter or the end of its element. The
# full stop of "St." is none.
_NAME = r"(?:location|based in|work ?place)"
_PLACE = rf"((?:[^.;|•·:{X.LINE_END}]++|(?<=(?<!{X.WORD})(?i:st))[.])++)"
_LABEL = (
    rf"(?:(?<!{X.WORD})(?i:{_NAME}) ?{X.LINE_END}?[:–-]"
    rf"|(?<![^{X.LINE_END}])(?i:(?:job |work )?{_NAME}){X.LINE_END})"
    rf"[ {X.LINE_END}]*+{_PLACE}"
)


def _named_places(text: Column) -> Column:
    """The classes of the preferred places that a text mentions; empty if none."""
    low = X.lowered(text)
    named = []
    for name, rules in terms.of_class("location").items():
        for _, _, _, term, _, unless, requires in rules:
            parts = [[x for x in (p or "").split("|") if x] for p in (term, unless, requires)]
            named.append(F.when(X.rule_holds(low, *parts), name))
    return F.concat_ws(", ", *named)


def page_location(html: Column, text: Column | None = None) -> Column:
    """Where a job is, from its page (``html``, best without what is invisible)
    and the page's ``text``: what follows a label such as "Location:", however
    long, up to a full stop or another delimiter or to the end of the element,
    then, unless a preferred place is among that, the preferred places that the
    rest of the page mentions; null if there is neither. The place may stand in
    the element after its label."""
    text = X.plain_text(html) if text is None else text
    label = F.when(
        X.lowered(html).rlike("location|based|work ?place"),
        F.nullif(F.trim(F.regexp_extract(X.text_lines(html), _LABEL, 1)), F.lit("")),
    )

    def joined(label: Column, text: Column) -> Column:
        places = F.nullif(_named_places(text), F.lit(""))
        both = F.nullif(F.concat_ws(", ", label, places), F.lit(""))
        return F.when(_named_places(label) != "", label).otherwise(both)

    # Bound to names, as each is looked at once for each rule.
    found = F.array(F.struct(label.alias("label"), text.alias("text")))
    return F.get(F.transform(found, lambda x: joined(x["label"], x["text"])), 0)


def postings_from_pages(
    pages: DataFrame, seen_at: Column | None = None, location: Column | None = None
) -> DataFrame:
    """Raw postings, one per page: the heading names the job, the page text is
    its description. ``seen_at`` defaults to the time the page file landed;
    ``location`` is an expression over the page's columns and its ``text``,
    ``title`` and ``h1``, by default ``page_location``. Each page is stripped of
    what is invisible once."""
    if seen_at is None:
        seen_at = F.col("_metadata.file_modification_time")
    if location is None:
        location = page_location(F.col(VISIBLE), F.col("text"))
    page = pages.withColumn("seen_at", seen_at).withColumn(
        VISIBLE, X.without_invisible(F.col("html"))
    )
    page = page.withColumns({**_fields(), "text": X.plain_text(F.col(VISIBLE))})
    return page.select(
        F.col("page_id").alias("posting_id"),
        "url",
        F.coalesce(F.nullif("h1", F.lit("")), "title").alias("title"),
        location.cast("string").alias("location"),
        F.col("text").alias("description"),
        "seen_at",
    )
