"""Links between orders, as records, and a metadata table made of the same orders with other spellings; some days have no metadata, some records no second party."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import link as L
from quern.plans.registry import query

RECORD = (
    "o_orderkey AS id", "o_orderdate AS day", "replace(c_name, 'Customer#', 'M/s. Customer & Sons ') AS pet", "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN ' . ' ELSE 'State of ' || n_name END AS res",
)
META = (
    "o_orderkey + 1000000 AS diary", "o_orderdate AS held_on",
    "CASE o_orderkey % 4 WHEN 0 THEN replace(c_name, 'Customer#0000', 'CUSTOMER AND SONS ') WHEN 1 THEN c_name ELSE 'm/s customer and son ' || o_custkey END AS first_party",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'STATE OF ' || n_name ELSE o_orderpriority END AS second_party",
)
FROM = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
NAME = "trim(regexp_replace(regexp_replace(replace(upper(coalesce({}, '')), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
ALIKE = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * (1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1}))) END"


@query(
    "date_party_link",
    f"""WITH r AS (SELECT id, day::DATE AS day, {NAME.format('pet')} AS p, {NAME.format('res')} AS q FROM (SELECT {', '.join(RECORD)} {FROM})),
      m AS (SELECT diary, held_on::DATE AS held_on, {NAME.format('first_party')} AS a, {NAME.format('second_party')} AS b FROM (SELECT {', '.join(META)} {FROM}) WHERE extract(day FROM held_on) <> 13),
      scored AS (SELECT id, diary, round(CASE WHEN q = '' OR b = '' THEN {ALIKE.format('p', 'a')} ELSE 0.55::DOUBLE * ({ALIKE.format('p', 'a')}) + 0.45::DOUBLE * ({ALIKE.format('q', 'b')}) END, 6) AS score FROM r JOIN m ON day = held_on),
      best AS (SELECT id, count(*) AS candidates, max(score) AS score FROM scored GROUP BY id), ties AS (SELECT id, min(diary) AS match, count(*) AS ties FROM scored JOIN best USING (id, score) GROUP BY id)
    SELECT id, coalesce(candidates, 0) AS candidates, round(score, 2) AS score, CASE WHEN score IS NULL THEN 'NO_MATCH' WHEN score >= 85 THEN 'HIGH_CONFIDENCE' WHEN score >= 65 THEN 'REVIEW' ELSE 'LOW_CONFIDENCE' END AS status, match, coalesce(ties, 0) AS ties
    FROM r LEFT JOIN best USING (id) LEFT JOIN ties USING (id)""",
)
def date_party_link(t):
    """By date, then the best of two weighted party similarities."""
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    metadata = joined.selectExpr(*META).where(F.dayofmonth("held_on") != 13)
    return L.link_by_date(joined.selectExpr(*RECORD), metadata, ("id", "day", "pet", "res"), ("diary", "held_on", "first_party", "second_party"))
