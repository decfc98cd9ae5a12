"""More registered queries: parsers, text functions, rules and row operators over whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import parsing as P
from ..functions import texts as X
from ..operators import analyse as N
from ..operators import convert as C
from ..operators import filters as L
from ..operators import reconcile as R
from ..operators import reshape as S
from ..operators import tidy as T
from .catalogue import _PAIRS, _RECON, _recon_sides, doubles, keyed, query, t

_SQL_PRICE = "o_totalprice::DECIMAL(18,2)"


def _price():
    return F.col("o_totalprice").cast("decimal(18,2)").cast("string")


def _choice(number, *cells):
    """One of the cells by a number's remainder."""
    out = F.lit(cells[-1]) if not hasattr(cells[-1], "isNotNull") else cells[-1]
    for i, c in reversed(list(enumerate(cells[:-1]))):
        out = F.when(number % len(cells) == i, c if hasattr(c, "isNotNull") else F.lit(c)).otherwise(out)
    return out


def _sql_choice(number: str, *cells: str) -> str:
    return f"CASE {number} % {len(cells)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cells)) + " END"


@query("SELECT c_custkey, " + _sql_choice("c_custkey", "true", "false", "true", "false", "NULL", "NULL") + " AS value, " + _sql_choice("c_custkey", "''", "''", "''", "''", "'not a boolean: maybe'", "'empty'") + " AS note FROM customer")
def boolean_cells(spark, sf):
    c = t(spark, sf, "customer", "c_custkey")
    b = P.boolean(_choice(F.col("c_custkey"), "Yes", " no", "TRUE", "0", "maybe", ""))
    return c.select("c_custkey", b["value"].alias("value"), b["note"].alias("note"))


@query(f"SELECT o_orderkey, round((CASE WHEN o_orderkey % 3 = 1 THEN -1 ELSE 1 END * {_SQL_PRICE})::DOUBLE, 2) AS v FROM orders")
def lenient_amounts(spark, sf):
    cell = _choice(F.col("o_orderkey"), F.concat(F.lit("EUR "), _price(), F.lit(" cr")), F.concat(F.lit("("), _price(), F.lit(")")), F.concat(F.lit("~"), _price()))
    return doubles(t(spark, sf, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", P.lenient_amount(cell).alias("v")), "v", places=2)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS d FROM orders")
def reconcile_dates(spark, sf):
    d = F.col("o_orderdate").cast("date")
    cell = _choice(F.col("o_orderkey"), *(F.date_format(d, f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "d MMM yyyy", "yyyyMMdd")), "soon")
    return t(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", P.reconcile_date(cell).cast("string").alias("d"))


@query("SELECT c_custkey, " + _sql_choice("c_custkey", "'USD'", "'GBP'", "'CNY'", "NULL", "'SGD'", "'EUR'") + " AS code FROM customer")
def reconcile_currencies(spark, sf):
    return t(spark, sf, "customer", "c_custkey").select("c_custkey", P.reconcile_currency(_choice(F.col("c_custkey"), "5 usd", "£7", "rmb 3", "12", "S$ 2", "9€")).alias("code"))


@query("SELECT c_custkey, " + _sql_choice("c_custkey", "'GBP'", "'USD'", "'SGD'") + " AS code FROM customer")
def resolved_codes(spark, sf):
    k = F.col("c_custkey")
    return t(spark, sf, "customer", "c_custkey").select("c_custkey", P.resolved_code(_choice(k, "£5", "5", "6"), _choice(k, "USD", "USD", ""), "SGD").alias("code"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN round({_SQL_PRICE}::DOUBLE, 2) WHEN 1 THEN round(-({_SQL_PRICE}::DOUBLE), 2) END AS chart, CASE o_orderkey % 3 WHEN 0 THEN round({_SQL_PRICE}::DOUBLE, 2) WHEN 1 THEN round(-({_SQL_PRICE}::DOUBLE), 2) END AS cell FROM orders")
def other_number_dialects(spark, sf):
    cell = _choice(F.col("o_orderkey"), F.concat(F.lit("£"), _price()), F.concat(F.lit("("), _price(), F.lit(")")), "n/a")
    return doubles(t(spark, sf, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", P.chart_number(cell).alias("chart"), P.table_number(cell).alias("cell")), "chart", "cell", places=2)


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN {_SQL_PRICE}::VARCHAR END AS value, CASE o_orderkey % 3 WHEN 0 THEN 'GBP' ELSE 'USD' END AS code, CASE WHEN o_orderkey % 3 = 2 THEN 'unknown' END AS raw FROM orders")
def converted_currencies(spark, sf):
    cell = _choice(F.col("o_orderkey"), F.concat(F.lit("£ "), _price()), F.concat(F.lit(" "), _price()), "unknown")
    c = P.converted(cell, "currency", None, "USD")
    return t(spark, sf, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", c["value"].cast("decimal(18,2)").cast("string").alias("value"), c["code"].alias("code"), c["raw"].alias("raw"))


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS sentence,
        array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part)""")
def cased_names(spark, sf):
    c = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return t(spark, sf, "part", "p_partkey", "p_name").select("p_partkey", *(X.cased(c, how).alias(name) for how, name in (("upper", "up"), ("lower", "low"), ("sentence", "sentence"), ("title", "title"))))


@query(r"SELECT c_custkey, regexp_replace(c_name || ' *x* (é) @', '[^\p{L}\p{N}\s.,&''()/-]', '', 'g') AS s FROM customer")
def stripped_names(spark, sf):
    return t(spark, sf, "customer", "c_custkey", "c_name").select("c_custkey", X.stripped(F.concat("c_name", F.lit(" *x* (é) @"))).alias("s"))


@query("SELECT c_custkey, " + _sql_choice("c_custkey", "'Café'", "'plain'", "'naïve'", "'a€b'") + " AS s FROM customer")
def repaired_encoding(spark, sf):
    return t(spark, sf, "customer", "c_custkey").select("c_custkey", X.repaired(_choice(F.col("c_custkey"), "CafÃ©", "plain", "naÃ¯ve", "a€b")).alias("s"))


@query(r"""SELECT doc_id, coalesce(text, '') <> regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^[ \t\n\f\r\x0B]+', ''), '[ \t\n\f\r\x0B]+$', ''), '[ \t\n\f\r\x0B]+', ' ', 'g') OR regexp_matches(coalesce(text, ''), 'Ã|Â|â€') AS noisy FROM documents""")
def noisy_cells(spark, sf):
    return t(spark, sf, "documents", "doc_id", "text").select("doc_id", X.noisy(F.col("text")).alias("noisy"))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE k % 5 = {i}) AS {n}" for i, n in ((3, "blank_rows"), (4, "total_rows"))) + ", count(*) FILTER (WHERE k % 5 < 3) AS n FROM (SELECT c_custkey AS k FROM customer)")
def blank_and_total_rows(spark, sf):
    k = F.col("c_custkey")
    df = keyed(t(spark, sf, "customer", "c_custkey", "c_name"), "c_custkey").select("_rid", F.when(k % 5 == 3, "  ").when(k % 5 == 4, " Grand Total ").otherwise(F.col("c_name")).alias("name"), F.when(k % 5 != 3, k.cast("string")).alias("v"))
    got = T.without_blank_and_total_rows(df)
    return got.report.crossJoin(got.df.agg(F.count("*").alias("n")))


@query("SELECT c_custkey, '[redacted] has [amount] and ' || c_mktsegment AS s FROM customer")
def redacted_cells(spark, sf):
    cell = F.concat(F.col("c_name"), F.lit(" has £1,234,567.89 and "), F.col("c_mktsegment"))
    named = t(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment").withColumn("cell", F.regexp_replace(cell, "^Customer#[0-9]+", "Acme Holdings"))
    return named.select("c_custkey", X.redacted(F.col("cell"), ["acme", "Acme Holdings"], True).alias("s"))


@query("SELECT c_custkey, c_name AS s FROM customer")
def cleaned_form_values(spark, sf):
    return t(spark, sf, "customer", "c_custkey", "c_name").select("c_custkey", X.cleaned_value(F.concat(F.lit("|: ...... "), F.col("c_name"), F.lit(" ____ |"))).alias("s"))


@query(r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '\p{Latin}') AS latin, regexp_matches(coalesce(text, ''), '\p{Cyrillic}') AS cyrillic, regexp_matches(coalesce(text, ''), '\p{Han}') AS han FROM documents""")
def scripts_of_texts(spark, sf):
    found = X.scripts(F.coalesce("text", F.lit("")))
    return t(spark, sf, "documents", "doc_id", "text").select("doc_id", *(F.array_contains(found, s).alias(s.lower()) for s in ("Latin", "Cyrillic", "Han")))


@query("SELECT c_custkey, " + _sql_choice("c_custkey", "'rtl'", "'ltr'", "'ltr'") + " AS d FROM customer")
def directions(spark, sf):
    return t(spark, sf, "customer", "c_custkey").select("c_custkey", X.direction(_choice(F.col("c_custkey"), "שלום abc", "hello", "مرحبا hello there")).alias("d"))


@query("""SELECT o_orderkey, abs(round_even(o_totalprice::DECIMAL(18,2) / 8, 1))::DOUBLE AS tenth, CASE WHEN o_totalprice >= 400000 THEN 'escalate' WHEN o_totalprice >= 100000 THEN 'material' ELSE 'immaterial' END AS size FROM orders""")
def rounding_and_materiality(spark, sf):
    v = F.col("o_totalprice").cast("decimal(18,2)")
    return t(spark, sf, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", A.rounded((v / 8).cast("decimal(28,6)"), 1).cast("double").alias("tenth"), A.materiality(-v, 100000, 400000).alias("size"))


@query("""SELECT o_orderkey, o_orderkey % 4 = 0 AS hinted FROM orders WHERE o_totalprice <> 0""")
def tax_hints(spark, sf):
    net = F.col("o_totalprice").cast("decimal(28,6)")
    gross = (net * F.when(F.col("o_orderkey") % 4 == 0, F.lit("1.20").cast("decimal(4,2)")).otherwise(F.lit("1.33").cast("decimal(4,2)"))).cast("decimal(28,6)")
    return t(spark, sf, "orders", "o_orderkey", "o_totalprice").where("o_totalprice <> 0").select("o_orderkey", A.tax_hint(net, gross).isNotNull().alias("hinted"))


@query("SELECT c_custkey, " + _sql_choice("c_custkey", "'ok'", "'mismatch'", "'ok'", "'ok'") + " AS lax, " + _sql_choice("c_custkey", "'ok'", "'mismatch'", "'unknown'", "'unknown'") + " AS strict FROM customer")
def currency_relations(spark, sf):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    a, b = _choice(k, "GBP", "GBP", "GBP", none), _choice(k, "GBP", "USD", none, none)
    return t(spark, sf, "customer", "c_custkey").select("c_custkey", A.currency_relation(a, b).alias("lax"), A.currency_relation(a, b, True).alias("strict"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice::DECIMAL(28,6) > 1000 AND lower(o_orderpriority) LIKE '%h%'""")
def conversion_filters(spark, sf):
    o = t(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    keep = L.matches(F.col("o_orderstatus"), "ne", "F") & L.matches(F.col("o_orderpriority"), "in", ["1-URGENT", "2-HIGH"]) & L.matches(_price(), "gt", "1,000") & L.matches(F.col("o_orderpriority"), "contains", "H") & L.matches(F.col("o_orderstatus"), "nonblank")
    return o.where(keep).select("o_orderkey")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Property' WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'FURNITURE' THEN 'Home' ELSE c_mktsegment END AS s FROM customer")
def mapped_values(spark, sf):
    return t(spark, sf, "customer", "c_custkey", "c_mktsegment").select("c_custkey", T.mapped(F.col("c_mktsegment"), {"building": "Property", "Home": ["House-Hold", "furniture"]}).alias("s"))


@query("""SELECT p_partkey AS row, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS name, p_retailprice::DECIMAL(18,2)::VARCHAR AS price, (DATE '2024-01-01' + (p_partkey % 300)::INTEGER)::VARCHAR AS day FROM part""")
def recipe_columns(spark, sf):
    p = keyed(t(spark, sf, "part", "p_partkey", "p_name", "p_retailprice"), "p_partkey")
    raw = p.select("_rid", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("Name "), F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("Price"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")), "dd/MM/yyyy").alias("Day"))
    got = T.apply_recipe(raw, {"columns": [{"source": "Name ", "name": "name", "case": "sentence"}, {"source": "Price", "name": "price", "type": "number"}, {"source": "Day", "name": "day", "type": "date"}]}).df
    return got.select(F.col("_rid").alias("row"), "name", F.col("price").cast("decimal(18,2)").cast("string").alias("price"), F.col("day").cast("string").alias("day"))


@query(_PAIRS + """, s AS (SELECT count(*) FILTER (WHERE bucket = 'matched') AS matched, count(*) FILTER (WHERE bucket <> 'matched') AS exceptions,
        count(*) FILTER (WHERE bucket <> 'matched' AND abs(CASE WHEN bucket = 'value_diff' THEN diff ELSE coalesce(av, bv) END) >= 1000) AS red FROM p)
    SELECT matched, exceptions, matched + exceptions AS total, round(100.0 * matched / (matched + exceptions), 1)::DOUBLE AS pct, CASE WHEN red > 0 THEN 'RED' WHEN exceptions > 0 THEN 'AMBER' ELSE 'GREEN' END AS rag FROM s""")
def recon_summary(spark, sf):
    buckets = R.match(*_recon_sides(spark, sf), _RECON)
    s = R.summarise(buckets, R.triage(buckets, _RECON))
    return spark.createDataFrame([(s["matched"], s["exceptions"], s["total"], float(s["pct_reconciled"]), s["rag"])], "matched long, exceptions long, total long, pct double, rag string")


_TIES = """WITH a AS (SELECT o_custkey AS g, sum(o_totalprice::DECIMAL(18,2)) AS s, count(*) AS n, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)"""


@query(_TIES + """ SELECT g::VARCHAR AS grp, n AS a_n, n AS b_n, ids[1] AS first_a, s::DOUBLE AS total FROM a WHERE n * 2 >= 3""")
def group_ties(spark, sf):
    a = keyed(t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey").where("o_orderkey % 2 = 0")
    a = a.withColumns({"o_custkey": F.col("o_custkey").cast("string"), "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)")})
    got = R.propose_aggregations(a, a, "o_custkey", "o_custkey", R.Options(amount="o_totalprice")).where("kind = 'group'")
    return got.select("grp", F.size("a_ids").cast("long").alias("a_n"), F.size("b_ids").cast("long").alias("b_n"), F.col("a_ids")[0].alias("first_a"), F.col("a_sum").cast("double").alias("total"))


@query("""SELECT r_regionkey * 2 + k AS id, variable, value FROM (SELECT r_regionkey, k, CASE k WHEN 0 THEN 'r_name' ELSE 'size' END AS variable, CASE k WHEN 0 THEN r_name ELSE length(r_name)::VARCHAR END AS value FROM region, (SELECT unnest([0, 1]) AS k))""")
def reshape_steps(spark, sf):
    r = t(spark, sf, "region", "r_regionkey", "r_name").withColumn("size", F.length("r_name").cast("string"))
    long = S.reshaped(r, [{"op": "unpivot", "id_cols": ["r_regionkey"], "value_cols": ["r_name", "size"]}])
    return long.select((F.col("r_regionkey") * 2 + F.when(F.col("variable") == "size", 1).otherwise(0)).cast("long").alias("id"), "variable", "value")


@query("""SELECT n_nationkey, 'lead.name.x' AS path, n_name AS v FROM nation""")
def flatten_structs(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey", "n_name").select("n_nationkey", F.struct(F.struct(F.col("n_name").alias("x")).alias("name")).alias("lead"))
    flat = S.flatten(n)
    return flat.select("n_nationkey", F.lit(flat.columns[1]).alias("path"), F.col("`lead.name.x`").alias("v"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_paths(spark, sf):
    return S.flatten_json(t(spark, sf, "events", "event_id", "props"), "props", ["k", "missing"]).drop("props")


@query("""WITH v AS (SELECT l_quantity::DECIMAL(28,6)::DOUBLE AS x, l_extendedprice::DECIMAL(28,6)::DOUBLE AS y FROM lineitem) SELECT count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(corr(x, y), 3) AS r FROM v""")
def scatter_line(spark, sf):
    f = N.scatter_fit(t(spark, sf, "lineitem", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return f.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "r")


@query("""WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS p, sum(o_totalprice::DECIMAL(28,2)) AS v FROM orders GROUP BY 1), k AS (SELECT p, v, p = min(p) OVER () AS first FROM m)
    SELECT p::INTEGER AS p, round((sum(v) OVER (ORDER BY p))::DOUBLE, 2) AS level FROM k""")
def bridge_levels(spark, sf):
    m = t(spark, sf, "orders", "o_orderdate", "o_totalprice").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("p")).agg(F.sum(F.col("o_totalprice").cast("decimal(28,2)")).alias("v"))
    low = m.agg(F.min("p").alias("low"))
    steps = m.crossJoin(F.broadcast(low)).withColumn("kind", F.when(F.col("p") == F.col("low"), "start").otherwise("delta")).drop("low")
    return doubles(N.bridge(steps, "p", "kind", "v").select("p", "level"), "level", places=2)


@query("""SELECT * FROM (VALUES ('amount', 'error'), ('ref', 'error')) AS v(col, severity)""")
def contract_gaps(spark, sf):
    columns = t(spark, sf, "orders").columns
    got = C.check_contract(columns, {"contract": [{"name": "amount", "required": True}, {"name": "ref", "required": True}, {"name": "day"}], "map": [{"target": "day", "source": "o_orderdate"}]})
    return spark.createDataFrame([(g["column"], g["severity"]) for g in got if g["severity"] == "error"], "col string, severity string")


_ALL_PII = {
    "relation": r"\bour[ \t\n\f\r\x0B]+(customer|customers|client|clients|supplier|suppliers|vendor|employee|employees|patient|patients|deal|seller|counterparty|target)\b",
    "activity": r"\bwe(''re|[ \t\n\f\r\x0B]+are|[ \t\n\f\r\x0B]+have|[ \t\n\f\r\x0B]+will|[ \t\n\f\r\x0B]+ll)?[ \t\n\f\r\x0B]+(investing|acquiring|buying|selling|divesting|funding|onboarding|considering)\b",
    "company_id": r"\b([0-9]{8,9}[a-z]|[a-z][0-9]{2}[a-z]{2}[0-9]{4}[a-z])\b",
    "phone": r"\b[+]?[0-9][0-9 \t\n\f\r\x0B-]{7,}[0-9]\b",
    "account": r"\b[0-9]{3,4}-[0-9]{4,6}-[0-9]{3,4}\b",
    "holding": r"\b[0-9]{1,3}[ \t\n\f\r\x0B]?%[ \t\n\f\r\x0B]?(stake|holding|interest|ownership)\b",
}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '(?i){p}') AS {n}" for n, p in _ALL_PII.items()) + " FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' we are acquiring 20% stake; our clients 12345678X' ELSE '' END AS text FROM documents)")
def more_pii_flags(spark, sf):
    d = t(spark, sf, "documents", "doc_id", "text")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " we are acquiring 20% stake; our clients 12345678X").otherwise(""))
    flags = X.pii_flags(text)
    return d.select("doc_id", *(flags[n].alias(n) for n in _ALL_PII))
