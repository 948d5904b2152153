"""A person panel derived from the ``orders`` table: the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PANEL_SQL = """
SELECT truth_id, ein, taxyr, object_id, table_id,
  first_name || ' ' || last_name || coalesce(' ' || suffix, '') AS name,
  first_name, last_name, suffix, gender, title_standard, tot_comp, org_state, org_cbsa, org_ntee,
  'EMP-' || upper(substr(md5(CAST(truth_id AS VARCHAR(20))), 1, 12)) AS EMP_ID
FROM (
  SELECT ck AS truth_id,
    'EIN-' || lpad(CAST(org_n AS VARCHAR(10)), 7, '0') AS ein, taxyr,
    'OID-' || lpad(CAST(okey AS VARCHAR(20)), 9, '0') AS object_id,
    'TID-' || lpad(CAST(j AS VARCHAR(10)), 5, '0') AS table_id,
    CASE WHEN h = 0 THEN split_part('BOB,BILL,DICK,JIM,LIZ,PEGGY,KATE,CHUCK,TOM,MIKE,ED,TONY,JOE,DAN,DAVE,SUE', ',', fi + 1)
         WHEN h = 1 THEN substr(split_part('ROBERT,WILLIAM,RICHARD,JAMES,ELIZABETH,MARGARET,KATHERINE,CHARLES,THOMAS,MICHAEL,EDWARD,ANTHONY,JOSEPH,DANIEL,DAVID,SUSAN', ',', fi + 1), 1, 1)
         ELSE split_part('ROBERT,WILLIAM,RICHARD,JAMES,ELIZABETH,MARGARET,KATHERINE,CHARLES,THOMAS,MICHAEL,EDWARD,ANTHONY,JOSEPH,DANIEL,DAVID,SUSAN', ',', fi + 1) END AS first_name,
    split_part('SMITH,JONES,GARCIA,LOPEZ,COHEN,WEINER,REED,NGUYEN,OKAFOR,HAALAND,GANTSOUDES,MCLANE,BERG,KIPPS,STEVENS,MARTIN,HOEY,WOOLFOLK,MADDOX,VANCE', ',', li + 1)
      || CASE WHEN h = 2 THEN '-LEE' ELSE '' END AS last_name,
    CASE WHEN s % 5 = 0 AND j = 0 THEN 'SR' WHEN s % 5 = 0 AND j = 1 THEN 'JR' END AS suffix,
    CASE WHEN fi IN (4, 5, 6, 15) THEN 'F' ELSE 'M' END AS gender,
    split_part('CEO,EXECUTIVE DIRECTOR,CHIEF FINANCIAL OFFICER,PRESIDENT,VICE PRESIDENT,SECRETARY,TREASURER,BOARD MEMBER,TRUSTEE,PROGRAM DIRECTOR,DIRECTOR OF MARKETING,CHAPLAIN', ',', CAST((ck + floor(taxyr / 3)) % 12 AS INT) + 1) AS title_standard,
    comp AS tot_comp,
    split_part('NY,NJ,CA,TX,NC,IL', ',', CAST(org_n % 6 AS INT) + 1) AS org_state,
    split_part('35620,10580,41860,39580,20500,16980,47900,28140,37980', ',', CAST(org_n % 9 AS INT) + 1) AS org_cbsa,
    split_part('B25,E20,L20,P20,A51,X20,S41', ',', CAST(org_n % 7 AS INT) + 1) AS org_ntee
  FROM (
    SELECT *,
      CAST((s * 5 + CASE WHEN s % 5 = 0 AND j = 1 THEN 0 ELSE j END * 7) % 16 AS INT) AS fi,
      CAST((s * 3 + floor(j / 2)) % 20 AS INT) AS li
    FROM (
      SELECT *, CASE WHEN org_n >= 180 AND j = 0 THEN org_n - 180 ELSE org_n END AS s, CAST((ck * 31 + taxyr * 17) % 20 AS INT) AS h
      FROM (
        SELECT CAST(o_custkey AS BIGINT) AS ck, CAST(o_custkey % 200 AS INT) AS org_n, CAST(floor(o_custkey / 200) AS INT) AS j,
          CAST(year(o_orderdate) AS INT) AS taxyr, max(o_totalprice) AS comp, min(o_orderkey) AS okey
        FROM orders GROUP BY 1, 2, 3, 4) b) sd) nm) p
"""


def synthetic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truth_id, ein, taxyr, native keys, name and parts, title, pay, place, EMP_ID by truth)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(PANEL_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)
