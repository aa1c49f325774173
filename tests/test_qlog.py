import pytest
from pyspark.sql import functions as F

from faultline.operators import impact as I, qlog as Q
from helpers import make_catalog

TABLES = {
    ("c", "shop.orders"): {"id": "NUMBER", "cust": "NUMBER", "zip": "VARCHAR", "amount": "FLOAT",
                           "status": "VARCHAR", "day": "DATE"},
    ("c", "shop.people"): {"cust": "NUMBER", "zip": "VARCHAR", "segment": "VARCHAR"},
}
# statement -> (usage, confidence, clauses) of shop.orders.zip
CASES = {
    "SELECT zip, SUM(amount) FROM shop.orders GROUP BY zip": ("select", "high", "group,select"),
    "SELECT LEFT(zip, 3) AS z FROM shop.orders": ("select", "high", "select"),
    "SELECT o.zip FROM shop.orders o WHERE o.status = 'zip'": ("select", "high", "select"),
    "SELECT id FROM shop.orders WHERE zip IS NOT NULL": ("filter", "high", "where"),
    "SELECT o.id FROM shop.orders o JOIN shop.people p ON o.zip = p.zip":
        ("filter", "high", "join"),
    "SELECT o.id FROM shop.orders o JOIN shop.people p USING (zip)": ("filter", "low", "join"),
    "SELECT amount FROM shop.orders": ("none", "high", ""),
    "SELECT zip FROM shop.people": ("none", "high", ""),
    "SELECT zip FROM shop.orders o JOIN shop.people p ON o.cust = p.cust":
        ("select", "low", "select"),
    "SELECT * FROM shop.orders": ("star", "medium", "select(*)"),
    "SELECT o.* FROM shop.orders o": ("star", "high", "select(*)"),
    "SELECT p.* FROM shop.orders o JOIN shop.people p ON o.cust = p.cust": ("none", "high", ""),
    "SELECT COUNT(*) FROM shop.orders": ("none", "high", ""),
    "SELECT *, zip FROM shop.orders": ("select", "high", "select,select(*)"),
    "SELECT COUNT(*) FROM shop.orders GROUP BY zip": ("filter", "high", "group"),
    "SELECT id FROM shop.orders GROUP BY id HAVING MAX(zip) > '1'": ("filter", "high", "having"),
    "SELECT id FROM shop.orders ORDER BY zip DESC NULLS LAST": ("filter", "high", "order"),
    "SELECT id FROM shop.orders QUALIFY COUNT(zip) OVER () > 1": ("filter", "high", "qualify"),
    "SELECT SUM(1) OVER (PARTITION BY zip ORDER BY day) FROM shop.orders":
        ("select", "high", "select"),
    "SELECT SUM(1) OVER (ORDER BY zip) FROM shop.orders": ("filter", "high", "order"),
    "SELECT id FROM shop.orders WHERE cust IN (SELECT zip FROM shop.orders)":
        ("select", "low", "select"),
    "WITH x AS (SELECT zip FROM shop.orders) SELECT zip FROM x": ("select", "medium", "select"),
    "SELECT t.a FROM (SELECT zip AS a FROM shop.orders) t": ("select", "high", "select"),
    "select O.ZIP from SHOP.ORDERS as O": ("select", "high", "select"),
    'SELECT "o"."zip" FROM "shop"."orders" "o"': ("select", "high", "select"),
    "SELECT id FROM shop.people, shop.orders WHERE orders.zip = 'a'": ("filter", "high", "where"),
    "SELECT id FROM shop.orders WHERE status = 'a -- zip' /* zip */ -- zip": ("none", "high", ""),
    "SELECT EXTRACT(year FROM day) FROM shop.orders WHERE zip IS NOT DISTINCT FROM status":
        ("filter", "high", "where"),
    "SELECT status zip FROM shop.orders": ("none", "high", ""),
    "SELECT zip FROM shop.orders JOIN other.t ON a = b": ("select", "medium", "select"),
    "SELECT missing FROM shop.orders": ("none", "high", ""),
    "SELECT zip FROM WHERE ORDER BAD(((": ("parse_error", "low", ""),
    "SELECT * FROM {{ ref('orders') }}": ("parse_error", "low", ""),
    "SELECT zip FROM shop.orders WHERE status = 'open": ("parse_error", "low", ""),
    "SELECT zip FORM shop orders": ("parse_error", "low", ""),
    "DELETE FROM shop.orders WHERE zip = '1'": ("parse_error", "low", ""),
    "SELECT zip FROM shop.orders; SELECT 1": ("parse_error", "low", ""),
    "": ("parse_error", "low", ""),
}


@pytest.fixture(scope="module")
def found(spark):
    cat = make_catalog(spark, TABLES, [("c", f"q{i}", s, "t", 1) for i, s in enumerate(CASES)])
    ch = spark.createDataFrame([("x", "c", "shop.orders", "zip", "drop", None)],
                               "change_id string, catalog string, dataset string, column string,"
                               " op string, new_name string")
    rows = I.impact_verdicts(ch, cat, I.build_index(cat), include_safe=True).collect()
    return {r.query_id: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_usage(found, i):
    sql, want = list(CASES.items())[i]
    r = found[f"q{i}"]
    assert (r.usage, r.confidence, ",".join(r.clauses)) == want, sql


# statements that must not read as safe when `column` of sales.t goes
CLOSED = [
    ("SELECT amount$1 FROM sales.t", "amount$1", "BREAKS"),
    ("SELECT größe FROM sales.t", "größe", "BREAKS"),
    ("SELECT name FROM (sales.t)", "name", "BREAKS"),
    ("SELECT name FROM ((sales.t))", "name", "UNKNOWN"),
    ("SELECT name FROM ONLY (sales.t)", "name", "UNKNOWN"),
    ("SELECT name FROM ONLY sales.t", "name", "UNKNOWN"),
    ("SELECT name FROM (VALUES (1)) v JOIN LATERAL sales.t ON true", "name", "UNKNOWN"),
    ("SELECT name FROM TABLE(sales.t)", "name", "UNKNOWN"),
    ("SELECT name FROM IDENTIFIER('sales.t')", "name", "UNKNOWN"),
    ("SELECT [name] FROM [sales].[t]", "name", "UNKNOWN"),
    ("SELECT name FROM a.b CROSS APPLY sales.t", "name", "UNKNOWN"),
    ("SELECT id, (name) FROM a.b, ONLY (sales.t)", "name", "UNKNOWN"),
    ("SELECT id FROM sales.t, unnest(tags) u", "id", "BREAKS"),
    ("SELECT tags[1] FROM sales.t", "id", "SAFE"),
    ("SELECT id FROM a.b NATURAL JOIN sales.t", "name", "UNKNOWN"),
    ("SELECT id FROM a.b UNION ALL TABLE sales.t", "name", "UNKNOWN"),
    ("SELECT id FROM a.b WHERE EXISTS (TABLE sales.t)", "name", "UNKNOWN"),
    ("SELECT id FROM a.b WHERE id IN sales.t", "name", "UNKNOWN"),
    ("SELECT id FROM a.b WHERE id IN (SELECT name FROM sales.t)", "name", "BREAKS"),
    ("SELECT x.name.first FROM sales.t x", "name", "BREAKS"),
    ("SELECT name.first FROM sales.t", "name", "BREAKS"),
    ("SELECT sales.t.name.first FROM sales.t", "name", "BREAKS"),
    ("SELECT x.id FROM sales.t x", "name", "SAFE"),
    ("SELECT sales.t.id FROM sales.t", "name", "SAFE"),
    ("SELECT t FROM sales.t t", "name", "DEGRADES"),
    ("SELECT row_to_json(t) FROM sales.t t", "name", "DEGRADES"),
    ("SELECT id FROM sales.t WHERE t IS NOT NULL", "name", "DEGRADES"),
    ('SELECT "T" FROM sales.t', "name", "DEGRADES"),
    ("SELECT $3 FROM sales.t", "name", "UNKNOWN"),
    ("SELECT COLUMNS('na.*') FROM sales.t", "name", "UNKNOWN"),
    ('SELECT U&"n\\0061me" FROM sales.t', "name", "UNKNOWN"),
    ("INSERT INTO mart.x SELECT name FROM sales.t", "name", "BREAKS"),
    ("INSERT INTO mart.x SELECT id FROM sales.t", "name", "SAFE"),
    ("INSERT OVERWRITE TABLE mart.x (SELECT * FROM sales.t)", "name", "DEGRADES"),
    ("INSERT INTO sales.t SELECT a, b FROM a.b", "name", "DEGRADES"),
    ("INSERT INTO sales.t (id, name) SELECT a, b FROM a.b", "name", "BREAKS"),
    ('INSERT INTO "sales"."t" ("name") WITH q AS (SELECT a FROM a.b) SELECT a FROM q', "name", "BREAKS"),
    ("INSERT INTO sales.t (id) SELECT a FROM a.b", "name", "SAFE"),
    ("INSERT INTO sales.t (id) VALUES (1)", "name", "UNKNOWN"),
    ("INSERT INTO mart.x SELECT id FROM a.b ON CONFLICT DO NOTHING", "name", "UNKNOWN"),
    ("CREATE OR REPLACE VIEW mart.v AS SELECT name FROM sales.t", "name", "BREAKS"),
    ("create table if not exists mart.v (k, n) as (select id, name from sales.t)", "name", "BREAKS"),
    ("CREATE TABLE sales.t AS SELECT a AS name FROM a.b", "name", "SAFE"),
    ("CREATE TABLE mart.v USING parquet AS SELECT id FROM sales.t", "name", "UNKNOWN"),
    ("CREATE TABLE sales.t (name INT)", "name", "UNKNOWN"),
]


def test_what_is_not_read_is_not_safe(spark):
    tables = {("c", "sales.t"): {"amount$1": "INT", "größe": "INT", "name": "VARCHAR", "id": "INT",
                                 "tags": "ARRAY"}}
    cat = make_catalog(spark, tables, [("c", f"q{i}", s, "t", 1) for i, (s, _, _) in enumerate(CLOSED)])
    cols = sorted({c for _, c, _ in CLOSED})
    ch = spark.createDataFrame([(c, "c", "sales.t", c, "drop", None) for c in cols],
                               "change_id string, catalog string, dataset string, column string,"
                               " op string, new_name string")
    rows = I.impact_verdicts(ch, cat, I.build_index(cat), include_safe=True).collect()
    assert len(rows) == len(cols) * len(CLOSED)
    got = {(r.query_id, r.change_id): r.verdict for r in rows}
    assert [got[f"q{i}", c] for i, (_, c, _) in enumerate(CLOSED)] == [v for _, _, v in CLOSED]


def test_write_edges(spark):
    tables = {("c", "sales.t"): {"id": "INT"}, ("c", "sales.u"): {"id": "INT"}}
    log = ["INSERT INTO sales.u SELECT id FROM sales.t WHERE id > 1", "INSERT INTO sales.u SELECT id FROM sales.t WHERE id > 2",
           "CREATE VIEW Mart.V AS WITH t2 AS (SELECT id FROM sales.t) SELECT u.id FROM sales.u u JOIN t2 ON u.id = t2.id",
           "SELECT id FROM sales.t", "INSERT INTO sales.u VALUES (1)", "CREATE TABLE x AS SELECT a FROM elsewhere.y"]
    cat = make_catalog(spark, tables, [("c", f"q{i}", s, "t", i + 1) for i, s in enumerate(log)])
    got = {tuple(r) for r in I.write_edges(cat.queries, cat).collect()}
    assert got == {("c", "urn:c:sales.t", "urn:c:sales.u", 2, 3), ("c", "urn:c:sales.t", "mart.v", 1, 3),
                   ("c", "urn:c:sales.u", "mart.v", 1, 3)}


def test_constants_share_a_shape(spark):
    df = spark.createDataFrame([("SELECT a FROM t WHERE x = 1 -- one",),
                                ("SELECT a FROM t  WHERE x = 25",),
                                ("SELECT a FROM t WHERE x = 'q'",)], "sql string")
    ids = Q.with_shape(df).select("sql", "shape_id").collect()
    assert ids[0].shape_id == ids[1].shape_id != ids[2].shape_id


def test_raw_tokens_give_the_text_back(spark):
    text = "SELECT a , 'it''s'  -- c\nFROM t.x /* y\nz */ WHERE b>=1.5e3;"
    df = spark.createDataFrame([(text,)], "sql string")
    assert df.select(F.array_join(Q.raw_tokens("sql"), "").alias("t")).first().t == text


def test_outputs(spark):
    df = spark.createDataFrame([("c", "q", "WITH w AS (SELECT z FROM t) SELECT a.b, SUM(c) AS s,"
                                 " d e, f + g, h FROM w UNION SELECT i FROM t")],
                               "catalog string, query_id string, sql string")
    assert [r.output for r in I.projected_columns(df).orderBy("pos").collect()] == [
        "b", "s", "e", "h"]


def test_plain_text_keeps_the_shape(spark):
    texts = [*CASES, "SELECT 'it''s', 1.5e3, t1.c2 FROM t1 WHERE a = -7", "SELECT 'open, 5",
             'SELECT "col 1" FROM t WHERE x = 3', "SELECT a /* 1 */ FROM t -- 2", "a\\'b' 1"]
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    df = df.withColumn("plain", Q.plain_text("sql"))
    a = Q.with_shape(df).select("sql", "shape_id")
    b = Q.with_shape(df, "plain").select("sql", F.col("shape_id").alias("other"))
    rows = a.join(b, "sql").collect()
    assert len(rows) == len(texts) and all(r.shape_id == r.other for r in rows)
