"""The registered queries as DuckDB SQL over the test tables.

Rules, titles and places are written out here once more, so that a wrong one in
the library does not go unnoticed."""

from __future__ import annotations



# Fixed values. The rules that have to do with the derived postings.
TITLES = [
    "Junior Software Engineer", "New Grad Software Engineer", "Entry-Level Software Developer",
    "Application Developer", "Frontend Developer", "Full-stack Developer", "Java Developer",
    "React / TypeScript Developer", "Junior AWS Engineer", "Senior Software Engineer",
    "Staff Engineer", "Engineering Manager",
]
LOCATIONS = [
    "Rochester, Minnesota", "Twin Cities", "Rochester", "Remote", "Hybrid - Twin Cities",
    "Austin", "Boston",
]
RULES = [
    ("role_junior", "role", "title", "junior software engineer", 10),
    ("role_newgrad", "role", "title", "new grad software engineer", 10),
    ("role_entry", "role", "title", "entry level software developer", 10),
    ("role_app", "role", "title", "application developer", 10),
    ("role_fe", "role", "title", "frontend developer", 10),
    ("role_fs", "role", "title", "full stack developer", 10),
    ("role_java", "role", "title", "java developer", 10),
    ("role_react", "role", "title", "react", 10),
    ("role_ts", "role", "title", "typescript", 10),
    ("role_aws", "role", "title", "junior aws", 10),
    ("loc_mn", "location", "location", "minnesota", 5),
    ("loc_tc", "location", "location", "twin cities", 5),
    ("loc_roc", "location", "location", "rochester", 5),
    ("loc_remote", "location", "location", "remote", 5),
    ("loc_hybrid", "location", "location", "hybrid", 5),
    ("pen_senior", "penalty", "title", "senior", -20),
    ("pen_staff", "penalty", "title", "staff", -20),
    ("pen_mgr", "penalty", "title", "manager", -20),
    ("pen_unpaid", "penalty", "description", "unpaid", -20),
    ("pen_contract", "penalty", "description", "contract only", -20),
    ("pen_years", "penalty", "years", "5", -20),
]
PAGE_RULES = [
    ("page_the", "role", "title", "the", 10),
    ("page_and", "role", "title", "and", 8),
    ("page_of", "location", "location", "of", 5),
    ("page_de", "location", "location", "de", 3),
    ("page_la", "penalty", "title", "la", -20),
    ("page_in_the", "penalty", "description", "in the", -7),
    ("page_que_de", "penalty", "description", "que de", -3),
]
# What each page says of its place, by hand: place, rules.
PAGE_PLACES = [
    ("the engineering campus of our partner at the western riverside office park in Rochester,"
     " Minnesota", "loc_mn,loc_roc"),
    ("St. Paul, Minnesota", "loc_mn,loc_tc"),
    ("Austin, Texas, remote", "loc_remote"),
    ("Boston", ""),
    ("twin cities", "loc_tc"),
    (None, ""),
    ("Rémote village, remote", "loc_remote"),
    ("Hybrid - Minneapolis, MN", "loc_hybrid,loc_mn,loc_tc"),
]
# What each wording stands for, by hand. Titles: class, senior, unpaid,
# contract only, rules of the title; places: class, rules; descriptions: years,
# unpaid, contract only.
WORDED_TITLES = [
    ("frontend developer", False, False, False, "role_fe"),
    ("full-stack developer", False, False, False, "role_fs"),
    ("java developer", True, False, False, "pen_senior,role_java"),
    ("frontend developer", False, True, False, "role_fe"),
    ("java developer", False, False, True, "role_java"),
    ("other", False, False, False, ""),
    ("junior software engineer", False, False, False, "role_junior"),
    ("other", False, False, False, ""),
    ("new grad software engineer", False, False, False, "role_newgrad"),
    ("react / typescript developer", True, False, False, "pen_mgr,role_react"),
]
WORDED_LOCATIONS = [
    ("other", ""),
    ("minnesota", "loc_hybrid,loc_mn,loc_tc"),
    ("other", ""),
    ("minnesota", "loc_mn,loc_roc"),
    ("hybrid", "loc_hybrid"),
    ("other", ""),
    ("twin cities", "loc_tc"),
    ("remote", "loc_remote"),
    ("twin cities", "loc_tc"),
    ("other", ""),
]
WORDED_DESCRIPTIONS = [
    (5, False, False),
    (5, False, False),
    (4, False, False),
    (5, False, False),
    (65, False, False),
    (25, False, False),
    (None, False, False),
    (None, True, False),
    (None, False, True),
    (3, False, False),
    (None, False, False),
]


def _values(rows: list[tuple], names: str) -> str:
    def text(value) -> str:
        if value is None:
            return "CAST(NULL AS INTEGER)"
        return f"'{value}'" if isinstance(value, str) else str(value)

    listed = ", ".join(f"({i}, {', '.join(map(text, row))})" for i, row in enumerate(rows))
    return f"(VALUES {listed}) AS w(i, {names})"


WORDED = f"""
titles AS (SELECT * FROM {_values(WORDED_TITLES, 'role_class, senior, unpaid_t, contract_t, rules_t')}),
places AS (SELECT * FROM {_values(WORDED_LOCATIONS, 'location_class, rules_l')}),
texts AS (SELECT * FROM {_values(WORDED_DESCRIPTIONS, 'years, unpaid_d, contract_d')}),
worded AS (
  SELECT o_orderkey AS posting_id, role_class, location_class, senior,
         unpaid_t OR unpaid_d AS unpaid, contract_t OR contract_d AS contract,
         years, coalesce(years >= 5, false) AS many, rules_t, rules_l
  FROM orders
  JOIN titles t ON t.i = o_orderkey % 10
  JOIN places p ON p.i = (o_orderkey // 10) % 10
  JOIN texts d ON d.i = (o_orderkey // 100) % 11
),
worded_rules AS (
  SELECT *, list_sort(list_filter(string_split(concat_ws(',', nullif(rules_t, ''), nullif(rules_l, ''),
      CASE WHEN unpaid THEN 'pen_unpaid' END, CASE WHEN contract THEN 'pen_contract' END,
      CASE WHEN many THEN 'pen_years' END), ','), lambda x: x <> '')) AS rules
  FROM worded
)"""


def _points(rules: str) -> str:
    """The score of a list of rule ids."""
    def some(prefix: str) -> str:
        return f"len(list_filter({rules}, lambda x: starts_with(x, '{prefix}')))"

    return (
        f"CAST(CASE WHEN {some('role_')} > 0 THEN 10 ELSE 0 END"
        f" + CASE WHEN {some('loc_')} > 0 THEN 5 ELSE 0 END - 20 * {some('pen_')} AS BIGINT)"
    )


WORDED_SCORES = f"""WITH {WORDED}
SELECT posting_id, {_points('rules')} AS score, array_to_string(rules, ',') AS matched_rules
FROM worded_rules"""

# Even keys hold one text; whether it is the place or the description decides
# what it means.
SWAPPED = f"""WITH {WORDED},
hit AS (
  SELECT posting_id % 50 AS id, 'https://jobs.example.com/' || posting_id AS url,
    list_sort(list_filter(string_split(concat_ws(',',
      CASE WHEN posting_id % 3 <> 2 THEN nullif(rules_t, '') END,
      CASE WHEN posting_id % 3 <> 2 AND unpaid_t
             OR posting_id % 3 = 1 AND posting_id % 2 = 0 THEN 'pen_unpaid' END,
      CASE WHEN posting_id % 3 <> 2 AND contract_t
             OR posting_id % 3 = 1 AND posting_id % 2 = 0 THEN 'pen_contract' END,
      CASE WHEN posting_id % 3 = 0 AND posting_id % 2 = 0 THEN 'loc_remote' END,
      CASE WHEN posting_id % 3 = 1 AND posting_id % 2 = 0 THEN 'pen_years' END), ','),
      lambda x: x <> '')) AS rules
  FROM (SELECT o_orderkey AS posting_id, t.* FROM orders JOIN titles t ON t.i = o_orderkey % 10)
)
SELECT id AS posting_id, url, {_points('rules')} AS score,
       array_to_string(rules, ',') AS matched_rules
FROM hit"""


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _rules(rules: list[tuple]) -> str:
    rows = ", ".join(f"('{i}', '{k}', '{f}', '{t}', {w})" for i, k, f, t, w in rules)
    return f"(VALUES {rows}) AS r(rule_id, kind, field, term, weight)"


def _norm(text: str) -> str:
    padded = f"' ' || lower(coalesce({text}, '')) || ' '"
    return rf"regexp_replace({padded}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"


def _has(text: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains({_norm(text)}, ' {p} ')" for p in phrases) + ")"


# One posting sighting per order.
RAW = f"""
raw AS (
  SELECT o_orderkey AS posting_id,
         CASE WHEN o_orderkey % 89 = 0 THEN ''
              ELSE 'https://jobs' || (o_custkey % 5) || '.example.com/p/' || o_custkey END AS url,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              ELSE ({_list(TITLES)})[o_custkey % 12 + 1] END AS title,
         ({_list(LOCATIONS)})[o_custkey % 7 + 1] AS location,
         'Requires ' || (o_orderkey % 9) || '+ years of experience. '
           || CASE WHEN o_orderkey % 7 = 0 THEN 'Contract-only'
                   WHEN o_orderkey % 11 = 0 THEN 'Unpaid internship'
                   ELSE 'Full-time' END || '.' AS description,
         o_orderdate AS seen_at,
         o_custkey AS customer
  FROM orders
)"""

VALID = f"""{RAW},
valid AS (
  SELECT * FROM raw
  WHERE posting_id IS NOT NULL AND seen_at IS NOT NULL
    AND trim(title) <> '' AND trim(url) <> ''
)"""

_YEARS = (
    r"([0-9]+)(?:[.][0-9]+)?\s*(?:[+]|plus)?\s*"
    r"(?:(?:-|–|—|to|or)\s*[0-9]+(?:[.][0-9]+)?\s*[+]?\s*)?"
    r"-?(?:years?|yrs?)(?:[^\p{L}]|$)"
)

YEARS = f"""{VALID},
mentions AS (
  SELECT posting_id,
         try_cast(unnest(regexp_extract_all(lower(description), '{_YEARS}', 1)) AS INTEGER) AS n
  FROM valid
),
years AS (
  SELECT v.*, m.years_required
  FROM valid v LEFT JOIN (
    SELECT posting_id, max(n) AS years_required FROM mentions GROUP BY posting_id
  ) m USING (posting_id)
)"""

MATCHES = f"""{YEARS},
texts AS (
  SELECT posting_id, years_required, {_norm('title')} AS title,
         {_norm('location')} AS location, {_norm('description')} AS description
  FROM years
),
hits AS (
  SELECT t.posting_id, r.rule_id, r.kind, CAST(r.weight AS BIGINT) AS weight
  FROM texts t, {_rules(RULES)}
  WHERE CASE r.field
          WHEN 'title' THEN contains(t.title, ' ' || r.term || ' ')
          WHEN 'location' THEN contains(t.location, ' ' || r.term || ' ')
          WHEN 'description' THEN contains(t.description, ' ' || r.term || ' ')
          ELSE t.years_required >= try_cast(r.term AS INTEGER) END
),
by_kind AS (
  SELECT posting_id, kind, CASE WHEN kind = 'penalty' THEN sum(weight) ELSE max(weight) END AS w,
         string_agg(rule_id, ',') AS ids
  FROM hits GROUP BY posting_id, kind
),
totals AS (
  SELECT v.posting_id, CAST(coalesce(sum(b.w), 0) AS BIGINT) AS score,
         coalesce(array_to_string(list_sort(string_split(string_agg(b.ids, ','), ',')), ','), '')
           AS matched_rules
  FROM valid v LEFT JOIN by_kind b USING (posting_id)
  GROUP BY v.posting_id
)"""

NEWEST = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY seen_at DESC, posting_id DESC) AS rn
  FROM {table}
) WHERE rn = 1"""

SCORED = f"""{MATCHES},
scored AS (
  SELECT n.*, t.score, t.matched_rules
  FROM ({NEWEST.format(table='valid')}) n JOIN totals t USING (posting_id)
),
strong AS (SELECT * FROM scored WHERE score >= 15)"""

TERMS = ["senior", "staff", "principal", "lead", "architect", "manager"]
SENIOR = _has("title", *TERMS)
MANY_YEARS = "coalesce(years_required >= 5, false)"
UNPAID = _has("description", "unpaid")
CONTRACT = _has("description", "contract only")

POSTING = "posting_id, url, title, location, description, CAST(seen_at AS VARCHAR) AS seen_at"

# Only the entities that occur in the test pages, the ampersand last.
_BLANKS = "[ \\t\\r\\n\\f\u00a0]+"


def _plain(markup: str) -> str:
    text = rf"regexp_replace({markup}, '<[/!?]?[A-Za-z][^>]*(?:>|\z)', ' ', 'g')"
    for entity, char in [("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")]:
        text = f"replace({text}, '&{entity};', '{char}')"
    return f"trim(regexp_replace({text}, '{_BLANKS}', ' ', 'g'))"


def _element(name: str) -> str:
    return _plain(rf"regexp_extract(body, '(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>', 1)")


BODY = r"""
body AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
           '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
           '(?s)<!--.*?-->', ' ', 'g') AS body
  FROM pages
)"""

PAGE_POSTINGS = f"""{BODY},
page_postings AS (
  SELECT page_id, url, {_element('h1')} AS title, {_plain('body')} AS description FROM body
),
page_texts AS (
  SELECT url, title AS shown, {_norm('title')} AS title, {_norm('title')} AS location,
         {_norm('description')} AS description
  FROM page_postings WHERE trim(title) <> '' AND trim(url) <> ''
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1
),
page_hits AS (
  SELECT t.url, r.kind, r.rule_id, r.weight
  FROM page_texts t JOIN {_rules(PAGE_RULES)}
    ON contains(CASE r.field WHEN 'title' THEN t.title WHEN 'location' THEN t.location
                             ELSE t.description END, ' ' || r.term || ' ')
),
page_scores AS (
  SELECT url,
         coalesce(max(weight) FILTER (kind = 'role'), 0)
           + coalesce(max(weight) FILTER (kind = 'location'), 0)
           + coalesce(sum(weight) FILTER (kind = 'penalty'), 0) AS score,
         string_agg(rule_id, ',' ORDER BY rule_id) AS matched_rules
  FROM page_hits GROUP BY url
)"""

ROLE_CLASS = f"""CASE
  WHEN {_has('title', 'junior software engineer')} THEN 'junior software engineer'
  WHEN {_has('title', 'new grad software engineer')} THEN 'new grad software engineer'
  WHEN {_has('title', 'entry level software developer')} THEN 'entry-level software developer'
  WHEN {_has('title', 'application developer')} THEN 'application developer'
  WHEN {_has('title', 'frontend developer')} THEN 'frontend developer'
  WHEN {_has('title', 'full stack developer')} THEN 'full-stack developer'
  WHEN {_has('title', 'java developer')} THEN 'java developer'
  WHEN {_has('title', 'react', 'typescript')} THEN 'react / typescript developer'
  WHEN {_has('title', 'junior aws', 'junior cloud')} THEN 'junior aws or cloud'
  ELSE 'other' END"""

LOCATION_CLASS = f"""CASE
  WHEN {_has('location', 'minnesota')} THEN 'minnesota'
  WHEN {_has('location', 'twin cities')} THEN 'twin cities'
  WHEN {_has('location', 'rochester')} THEN 'rochester'
  WHEN {_has('location', 'hybrid')} THEN 'hybrid'
  WHEN {_has('location', 'remote')} THEN 'remote'
  ELSE 'other' END"""

ALL_MATCHES = f"""WITH {MATCHES}
SELECT v.posting_id, h.rule_id, h.kind, h.weight FROM valid v LEFT JOIN hits h USING (posting_id)"""

FIRST_SEEN = f"WITH {VALID} SELECT DISTINCT url FROM valid"

OUTBOX = f"WITH {SCORED} SELECT url, score, matched_rules FROM strong"

REVIEW = f"WITH {SCORED} SELECT posting_id, url, title, score, matched_rules FROM scored"

SQL: dict[str, str] = {
    "scan_pages": "SELECT page_id, url, html FROM pages",
    "pages_as_json": "SELECT page_id, url, html FROM pages",
    "postings_as_json": f"""WITH {VALID}
SELECT {POSTING} FROM (SELECT * REPLACE (
  seen_at + to_microseconds(posting_id * 7919 % 1000000) AS seen_at) FROM valid)""",
    "save_postings": f"""WITH {MATCHES}
SELECT {POSTING}, score, matched_rules
FROM ({NEWEST.format(table='valid')}) JOIN totals USING (posting_id)""",
    "compacted_postings": f"""WITH {MATCHES}
SELECT {POSTING}, score, matched_rules
FROM ({NEWEST.format(table='valid')}) JOIN totals USING (posting_id)""",
    "list_postings": f"WITH {SCORED} SELECT {POSTING}, score FROM scored WHERE score > 0",
    "worded_flags": f"""WITH {WORDED}
SELECT posting_id, role_class, location_class, senior AS is_senior, unpaid AS is_unpaid,
       contract AS is_contract_only, years AS years_required, many AS many_years,
       senior OR many AS not_entry_level
FROM worded""",
    "worded_clean": f"""WITH {WORDED}
SELECT posting_id FROM worded WHERE NOT (senior OR many OR unpaid OR contract)""",
    "worded_scores": WORDED_SCORES,
    "worded_scores_by_phrase": WORDED_SCORES,
    "swapped_scores": SWAPPED,
    "swapped_scores_by_phrase": SWAPPED,
    "swapped_scores_unbroadcast": SWAPPED,
    "outbox": OUTBOX,
    "page_text": f"WITH {BODY} SELECT page_id, {_plain('body')} AS text FROM body",
    "page_fields": rf"""WITH {BODY}
SELECT page_id, url, {_element('title')} AS title, {_element('h1')} AS h1,
       lower(regexp_extract(body, '(?i)<html[^>]*\slang="([^"]*)"', 1)) AS lang,
       lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host
FROM body""",
    "page_postings": f"""WITH {PAGE_POSTINGS}
SELECT t.url, t.shown AS title, CAST(coalesce(s.score, 0) AS BIGINT) AS score,
       coalesce(s.matched_rules, '') AS matched_rules
FROM page_texts t LEFT JOIN page_scores s USING (url)""",
    "page_locations": f"""
SELECT page_id AS posting_id, p.location, CAST(CASE WHEN p.rules = '' THEN 0 ELSE 5 END AS BIGINT) AS score,
       p.rules AS matched_rules
FROM pages JOIN (VALUES {', '.join(
    f"({n}, {'NULL' if place is None else repr(place)}, '{rules}')"
    for n, (place, rules) in enumerate(PAGE_PLACES)
)}) AS p (n, location, rules) ON page_id % {len(PAGE_PLACES)} = p.n""",
    "valid_postings": f"WITH {VALID} SELECT {POSTING} FROM valid",
    "rejected_postings": f"""WITH {RAW}
SELECT {POSTING}, concat_ws(',', CASE WHEN coalesce(title, '') = '' THEN 'no_title' END,
                                 CASE WHEN coalesce(url, '') = '' THEN 'no_url' END)
         AS reject_reason
FROM raw WHERE coalesce(title, '') = '' OR coalesce(url, '') = ''""",
    "role_class": f"WITH {VALID} SELECT posting_id, title, {ROLE_CLASS} AS role_class FROM valid",
    "location_class": f"""WITH {VALID}
SELECT posting_id, location, {LOCATION_CLASS} AS location_class FROM valid""",
    "is_senior": f"WITH {VALID} SELECT posting_id, {SENIOR} AS is_senior FROM valid",
    "years_required": f"""WITH {YEARS}
SELECT posting_id, years_required, {MANY_YEARS} AS many_years FROM years""",
    "is_unpaid": f"WITH {VALID} SELECT posting_id, {UNPAID} AS is_unpaid FROM valid",
    "is_contract_only": f"WITH {VALID} SELECT posting_id, {CONTRACT} AS is_contract_only FROM valid",
    "not_entry_level": f"""WITH {YEARS}
SELECT posting_id, ({SENIOR} OR {MANY_YEARS}) AS not_entry_level FROM years""",
    "junior_friendly": f"""WITH {YEARS}
SELECT posting_id, title, description FROM years WHERE NOT ({SENIOR} OR {MANY_YEARS})""",
    "drop_disqualified": f"""WITH {YEARS}
SELECT posting_id, title, description FROM years
WHERE NOT ({SENIOR} OR {MANY_YEARS} OR {UNPAID} OR {CONTRACT})""",
    "match_rules": ALL_MATCHES,
    "match_rules_by_phrase": ALL_MATCHES,
    "score": f"WITH {MATCHES} SELECT posting_id, score FROM totals",
    "explain_score": f"WITH {MATCHES} SELECT posting_id, matched_rules FROM totals",
    "score_postings": f"WITH {MATCHES} SELECT posting_id, score, matched_rules FROM totals",
    "find_and_score": f"""WITH {SCORED}
SELECT {POSTING}, score, matched_rules FROM scored""",
    "latest": f"WITH {VALID} SELECT {POSTING} FROM ({NEWEST.format(table='valid')})",
    "new_postings": f"""WITH {VALID}
SELECT posting_id, url, title FROM ({NEWEST.format(table='valid')}) WHERE customer % 2 <> 0""",
    "unnotified": f"WITH {SCORED} SELECT posting_id, url, score FROM strong WHERE customer % 4 <> 0",
    "unreviewed": f"WITH {SCORED} SELECT posting_id, url, score FROM scored WHERE customer % 3 <> 0",
    "review_list": f"{REVIEW} ORDER BY score DESC, posting_id",
    "review_top": f"{REVIEW} ORDER BY score DESC, posting_id LIMIT 100",
    "strong_fits": f"WITH {SCORED} SELECT posting_id, url, score, matched_rules FROM strong",
    "save_and_review": f"""WITH {SCORED}
SELECT {POSTING}, score, matched_rules FROM scored WHERE customer % 3 <> 0
ORDER BY score DESC, posting_id""",
    "scan_stream": "SELECT page_id, url, html FROM pages",
    "first_seen": FIRST_SEEN,
    "first_seen_by_state": FIRST_SEEN,
    "late_sightings": f"""WITH {VALID},
landed AS (
  SELECT 1 AS batch, * FROM valid WHERE posting_id % 3 = 0
  UNION ALL SELECT 2, * FROM valid WHERE posting_id % 3 <= 1
  UNION ALL SELECT 3, * FROM valid WHERE posting_id % 2 = 0
  UNION ALL SELECT 4, * FROM valid WHERE posting_id % 2 = 1
),
newest AS (SELECT batch, max(seen_at) AS top FROM landed GROUP BY batch)
SELECT posting_id, url, count(*) AS times FROM landed l
WHERE seen_at <= (SELECT max(top) FROM newest n WHERE n.batch < l.batch) - INTERVAL 365 DAY
GROUP BY posting_id, url""",
    "first_seen_within": f"""WITH {VALID}
SELECT DISTINCT url, CAST(epoch(seen_at) AS BIGINT) // (200 * 86400) AS seen_period FROM valid""",
    "notify_stream": f"""WITH {MATCHES},
batches AS (
  SELECT *, CASE WHEN posting_id % 5 = 0 AND seen_at < '1997-01-01' THEN 4
                 WHEN seen_at < '1994-01-01' THEN 1 WHEN seen_at < '1997-01-01' THEN 2
                 ELSE 3 END AS batch
  FROM valid JOIN totals USING (posting_id)
),
newest AS (
  SELECT * FROM batches
  QUALIFY row_number() OVER (PARTITION BY url, batch ORDER BY seen_at DESC, posting_id DESC) = 1
),
current AS (
  SELECT n.* FROM newest n WHERE NOT EXISTS (
    SELECT 1 FROM newest o WHERE o.url = n.url AND o.batch < n.batch
      AND (o.seen_at > n.seen_at OR o.seen_at = n.seen_at AND o.posting_id > n.posting_id))
)
SELECT url, arg_min(score, batch) AS score, arg_min(matched_rules, batch) AS matched_rules
FROM current WHERE score >= 15 GROUP BY url""",
    "watch_pages": f"""WITH {PAGE_POSTINGS}
SELECT url, CAST(score AS BIGINT) AS score, matched_rules FROM page_scores WHERE score >= 8""",
}
