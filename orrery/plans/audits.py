"""Queries of the schema audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import audit
from orrery.plans import views as V
from orrery.session import table

F5 = 'schema, "table"'


def _sql(body: str) -> str:
    return f"WITH {V.AUDIT_WITH} {body}"


RULE_SQL = {
    "tbl001": """SELECT l.schema, l."table", 'TBL001' AS rule_id, 'high' AS severity, 'no primary key' AS evidence FROM lasting l
        WHERE NOT EXISTS (SELECT 1 FROM columns c WHERE c.is_pk AND c.schema = l.schema AND c."table" = l."table")""",
    "idx001": """SELECT schema, "table", 'IDX001' AS rule_id, CASE WHEN sum(coalesce(nullif(freq, 0), 1)) > 2 THEN 'high' ELSE 'medium' END AS severity,
        "column" || '|' || sum(coalesce(nullif(freq, 0), 1)) || '|' || count(DISTINCT fingerprint) || '|' || array_to_string(list_sort(list(DISTINCT location))[1:3], ',') AS evidence
        FROM bare WHERE usage = 'where' GROUP BY schema, "table", "column" """,
    "idx002": """SELECT DISTINCT schema, "table", 'IDX002' AS rule_id, 'medium' AS severity, "index" || '|' || array_to_string(us, ',') AS evidence FROM
        (SELECT schema, "table", fingerprint, list_sort(list(DISTINCT "column")) AS us FROM used WHERE usage = 'where' GROUP BY ALL) JOIN indexes USING (schema, "table")
        WHERE len(columns) >= 2 AND list_has_any(us, columns) AND NOT list_contains(us, columns[1])""",
    "idx003": """SELECT a.schema, a."table", 'IDX003' AS rule_id, 'low' AS severity, a."index" || '|' || b."index" AS evidence FROM indexes a JOIN indexes b
        ON a.schema = b.schema AND a."table" = b."table" AND a.is_unique = b.is_unique AND len(a.columns) < len(b.columns) AND b.columns[1:len(a.columns)] = a.columns
        JOIN lasting l ON l.schema = a.schema AND l."table" = a."table" """,
    "idx004": """SELECT DISTINCT schema, "table", 'IDX004' AS rule_id, 'medium' AS severity, "column" || '|' || fingerprint AS evidence FROM bare WHERE usage = 'join'""",
    "idx005": """SELECT DISTINCT l.schema, l."table", 'IDX005' AS rule_id, 'medium' AS severity, "column" || '|' || kind || '|' || fingerprint AS evidence FROM patterns p JOIN lasting l ON p."table" = l."table" """,
    "idx101": """SELECT schema, "table", 'IDX101' AS rule_id, 'low' AS severity, row_count || '|' || n AS evidence FROM lasting JOIN
        (SELECT schema, "table", count(*) AS n FROM indexes GROUP BY ALL) USING (schema, "table") WHERE row_count < 5000 AND n > 4""",
    "idx102": """SELECT schema, "table", 'IDX102' AS rule_id, 'medium' AS severity, "index" || '|' || cardinality AS evidence FROM indexes JOIN lasting USING (schema, "table")
        WHERE len(columns) = 1 AND row_count > 0 AND cardinality * 10 < row_count""",
    "idx103": """SELECT c.schema, c."table", 'IDX103' AS rule_id, 'medium' AS severity, c."column" || '|' || round(c.top_share, 4) AS evidence FROM columns c
        JOIN indexed i ON c.schema = i.schema AND c."table" = i."table" AND c."column" = i."column" JOIN lasting l ON l.schema = c.schema AND l."table" = c."table" WHERE c.top_share > 0.9""",
    "qry101": """SELECT schema, "table", 'QRY101' AS rule_id, CASE WHEN r > 10000 THEN 'high' ELSE 'medium' END AS severity, fingerprint || '|' || CAST(floor(r) AS BIGINT) AS evidence
        FROM (SELECT *, rows_scanned / greatest(1, rows_returned) AS r FROM slow) WHERE r > 1000""",
}


def _rule(name: str, *names: str):
    return lambda spark, sf: getattr(audit, name)(*V.audit(spark, *names))


ALL = ("tables", "columns", "indexes", "accesses", "patterns", "slow")
CATALOG = {
    "rule_tbl001": (_rule("tbl001", "tables", "columns"), _sql(RULE_SQL["tbl001"])),
    "rule_idx001": (_rule("idx001", *ALL[:4]), _sql(RULE_SQL["idx001"])),
    "rule_idx002": (_rule("idx002", *ALL[:4]), _sql(RULE_SQL["idx002"])),
    "rule_idx003": (_rule("idx003", "tables", "indexes"), _sql(RULE_SQL["idx003"])),
    "rule_idx004": (_rule("idx004", *ALL[:4]), _sql(RULE_SQL["idx004"])),
    "rule_idx005": (_rule("idx005", "tables", "patterns"), _sql(RULE_SQL["idx005"])),
    "rule_idx101": (_rule("idx101", "tables", "indexes"), _sql(RULE_SQL["idx101"])),
    "rule_idx102": (_rule("idx102", "tables", "indexes"), _sql(RULE_SQL["idx102"])),
    "rule_idx103": (_rule("idx103", "tables", "columns", "indexes"), _sql(RULE_SQL["idx103"])),
    "rule_qry101": (_rule("qry101", "slow"), _sql(RULE_SQL["qry101"])),
    "audit_summary": (
        lambda spark, sf: audit.run(*V.audit(spark, *ALL)).groupBy("schema", "rule_id", "severity").agg(F.count("*").alias("findings")),
        _sql("SELECT schema, rule_id, severity, count(*) AS findings FROM (" + " UNION ALL ".join(f"({s})" for s in RULE_SQL.values()) + ") GROUP BY ALL"),
    ),
    "audit_unavailable": (
        lambda spark, sf: audit.unavailable(*(V.audit(spark, "tables")[0].where("schema = 'crm'"), *V.audit(spark, "indexes", "columns"), V.audit(spark, "slow")[0].where("schema = 'shop'"))),
        _sql("SELECT 'crm' AS schema, 'QRY101' AS rule_id"),
    ),
    "profile_columns": (
        lambda spark, sf: audit.column_profile(table(spark, sf, "lineitem"), "l_returnflag").unionByName(audit.column_profile(table(spark, sf, "part"), "p_size")),
        """SELECT value, n, share FROM (SELECT CAST(l_returnflag AS VARCHAR) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10)
        UNION ALL SELECT * FROM (SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10)""",
    ),
}
