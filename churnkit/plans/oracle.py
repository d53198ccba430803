"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the reference scripts' T-SQL, not from the Spark code: the
fixture adapters, the staging rules and each analysis are restated in
DuckDB's dialect over the pre-registered test tables. Dialect notes:

* DuckDB sorts NULLs last by default; T-SQL sorts them first ascending.
* DuckDB's double->int cast rounds; T-SQL truncates: ``trunc`` first.
* DuckDB's ``try_cast('12.0' as int)`` is 12; T-SQL gives NULL: guard.
* ``round`` on doubles: Spark rounds the shortest decimal form half up,
  so the oracle rounds the same decimal form (``R`` below).
* Sums of integers are cast to BIGINT (DuckDB widens them to HUGEINT).
"""

from __future__ import annotations

from churnkit import config as C
from churnkit.sources import fixtures as FX

REF = f"DATE '{C.FIXTURE_REFERENCE_DATE}'"
INCEPTION = f"DATE '{C.FIXTURE_INCEPTION_DATE}'"


def R(expr: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal form of a double."""
    return f"CAST(ROUND(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def _lit(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _pick(values, index: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def _map(col: str, variants: dict, default: str) -> str:
    key = f"upper(trim({col}))"
    arms = " ".join(
        f"WHEN {key} IN ({', '.join(_lit(s) for s in spellings)}) THEN {_lit(clean)}"
        for clean, spellings in variants.items()
    )
    return f"CASE {arms} ELSE {default} END"


def _less_than_bands(col: str, limits, top: str) -> str:
    arms = " ".join(f"WHEN {col} < {limit} THEN {_lit(label)}" for limit, label in limits)
    return f"{arms} ELSE {_lit(top)} END"


def _bit(col: str) -> str:
    t = f"trim({col})"
    return (
        f"CASE WHEN regexp_full_match({t}, '[+-]?0+') THEN 0 "
        f"WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN 1 "
        f"WHEN upper({t}) = 'TRUE' THEN 1 WHEN upper({t}) = 'FALSE' THEN 0 END"
    )


def _id(prefix: str, k: str) -> str:
    return f"{prefix} || lpad(CAST({k} AS VARCHAR), 9, '0')"


def _dstr(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


def _int_via_float(col: str) -> str:
    return f"TRY_CAST(trunc(TRY_CAST({col} AS DOUBLE)) AS INTEGER)"


# ----------------------------------------------------------------- CTEs

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (sql, deps)


cte("ostats", """
SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS fo, CAST(max(o_orderdate) AS DATE) AS lo,
       count(*) AS n
FROM orders GROUP BY o_custkey""")

cte("cust", """
SELECT c.c_custkey AS k, c.c_name, c.c_acctbal, r.r_name
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")

_product_name = "CASE prio " + " ".join(
    f"WHEN {_lit(p)} THEN {_pick(sp, 'k % 3')}" for p, sp in FX.PRODUCT_SPELLINGS.items()
) + f" ELSE {_pick(FX.OTHER_PRODUCT_SPELLINGS, 'k % 4')} END"

cte("raw_customers", f"""
SELECT {_id("'C'", "c.k")} AS customer_id,
       split_part(c.c_name, '#', 1) AS first_name,
       split_part(c.c_name, '#', 2) AS last_name,
       CASE WHEN c.k % 37 = 0 THEN NULL
            ELSE {_dstr(f"DATE '{FX.DOB_BASE}' + CAST((c.k * 7919) % 20000 AS INTEGER)")} END AS date_of_birth,
       {_pick(FX.GENDER_SPELLINGS, 'c.k % 6')} AS gender,
       CASE WHEN c.k % 4 = 1 THEN ' ' || lower(c.r_name) || ' '
            WHEN c.k % 4 = 2 THEN substr(c.r_name, 1, 2)
            ELSE c.r_name END AS province,
       {_pick(FX.BRANCH_SPELLINGS, 'c.k % 5')} AS branch_code,
       CASE WHEN c.k % 53 = 0 THEN '2031-01-01'
            WHEN c.k % 41 = 0 THEN 'unknown'
            WHEN c.k % 5 = 0 THEN {_dstr("o.fo + CAST((c.k * 37) % 2400 AS INTEGER)")}
            ELSE {_dstr("o.fo - CAST(c.k % 300 AS INTEGER)")} END AS join_date,
       CASE WHEN c.k % 29 = 0 THEN NULL WHEN c.k % 3 = 0 THEN 'Inactive' ELSE 'Active' END AS account_status,
       CASE WHEN c.k % 31 = 0 THEN NULL WHEN c.k % 97 = 0 THEN 'n/a'
            ELSE CAST(3500 + (c.k * 7919) % 80000 + d.dup * 500 AS VARCHAR) || '.0' END AS monthly_income
FROM cust c
LEFT JOIN ostats o ON o.k = c.k
CROSS JOIN (SELECT 0 AS dup UNION ALL SELECT 1) d
WHERE d.dup = 0 OR c.k % 50 = 7""", ("cust", "ostats"))

cte("raw_products", f"""
SELECT {_id("'C'", "k")} AS customer_id,
       {_product_name} AS product_name,
       CASE WHEN k % 43 = 0 THEN NULL WHEN k % 19 = 0 THEN '1990-01-01' ELSE {_dstr("fo")} END AS open_date,
       CASE WHEN k % 23 = 0 THEN NULL WHEN st = 'F' THEN 'Closed' ELSE 'Active' END AS product_status
FROM (SELECT o_custkey AS k, o_orderpriority AS prio, CAST(min(o_orderdate) AS DATE) AS fo,
             min(o_orderstatus) AS st
      FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) >= 3) g""")

cte("raw_activity", f"""
SELECT {_id("p.prefix", "c.c_custkey")} AS customer_id,
       CASE WHEN c.c_custkey % 61 = 0 THEN NULL WHEN c.c_custkey % 1499 = 11 THEN '4200000.0'
            ELSE CAST(CAST(floor(c.c_acctbal * 25) AS BIGINT) AS VARCHAR) || '.0' END AS avg_monthly_balance,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL
            ELSE CAST(290 + (c.c_custkey * 31) % 580 AS VARCHAR) || '.0' END AS credit_score,
       CASE WHEN c.c_custkey % 47 = 0 THEN NULL ELSE CAST((coalesce(o.n, 0) * 3) % 25 AS VARCHAR) END
           AS num_transactions_3m,
       CASE WHEN (c.c_custkey * 7) % 10 < 6 THEN '1' ELSE '0' END AS is_active_member,
       CASE WHEN c.c_custkey % 59 = 0 THEN '1990-06-01' ELSE {_dstr("o.lo")} END AS last_txn_date,
       CASE WHEN (c.c_custkey * 13) % 9 < 2 THEN '1' ELSE '0' END AS churned,
       CASE WHEN (c.c_custkey * 13) % 9 < 2 THEN {_dstr("o.lo")} END AS churn_date
FROM customer c
LEFT JOIN ostats o ON o.k = c.c_custkey
CROSS JOIN (SELECT 'C' AS prefix UNION ALL SELECT 'X') p
WHERE p.prefix = 'C' OR c.c_custkey % 150 = 5""", ("ostats",))

# --- staging.customers (deduplicate, map, parse, derive)
cte("dedup", """
SELECT *, row_number() OVER (PARTITION BY customer_id
                             ORDER BY TRY_CAST(monthly_income AS DOUBLE) ASC NULLS FIRST) AS row_num
FROM raw_customers""", ("raw_customers",))

_age = f"(year({REF}) - year(date_of_birth))"
_age_arms = " ".join(f"WHEN {_age} BETWEEN {lo} AND {hi} THEN {_lit(label)}" for lo, hi, label in C.AGE_RANGES)
_tenure = f"date_diff('day', join_date, {REF})"

cte("stg_base_customers", f"""
SELECT d.customer_id, d.first_name, d.last_name,
       TRY_CAST(d.date_of_birth AS DATE) AS date_of_birth,
       {_map("d.gender", C.GENDER_VARIANTS, "'Unknown'")} AS gender,
       {_map("d.province", C.REGION_VARIANTS, "'Unknown'")} AS province,
       CASE WHEN upper(trim(d.branch_code)) = 'JHB-CBD' THEN 'Johannesburg CBD' ELSE d.branch_code END AS branch_code,
       TRY_CAST(d.join_date AS DATE) AS join_date,
       CASE WHEN TRY_CAST(d.join_date AS DATE) IS NULL THEN 0
            WHEN TRY_CAST(d.join_date AS DATE) > {REF} THEN 0 ELSE 1 END AS is_valid_join_date,
       coalesce(d.account_status, 'Unknown') AS account_status,
       {_int_via_float("d.monthly_income")} AS monthly_income
FROM dedup d
WHERE d.row_num = 1 AND d.customer_id IS NOT NULL""", ("dedup",))

cte("stg_customers", f"""
SELECT customer_id, first_name, last_name, date_of_birth, gender, province, branch_code, join_date,
       is_valid_join_date, account_status, monthly_income,
       CASE WHEN date_of_birth IS NULL THEN NULL ELSE CAST({_age} AS INTEGER) END AS age,
       CASE WHEN date_of_birth IS NULL THEN 'Unknown' {_age_arms}
            WHEN {_age} > {C.AGE_ABOVE[0]} THEN {_lit(C.AGE_ABOVE[1])} ELSE 'Unknown' END AS age_band,
       CASE WHEN is_valid_join_date = 0 THEN NULL ELSE CAST({_tenure} AS INTEGER) END AS tenure_days,
       CASE WHEN is_valid_join_date = 0 THEN 'Unknown' {_less_than_bands(_tenure, C.TENURE_BANDS, C.TENURE_TOP)}
           AS tenure_band,
       CASE WHEN monthly_income IS NULL THEN 'Unknown'
            {_less_than_bands("monthly_income", C.INCOME_TIERS, C.INCOME_TOP)} AS income_tier
FROM stg_base_customers""", ("stg_base_customers",))

_first_join_sub = f"""(SELECT min(TRY_CAST(c.join_date AS DATE)) FROM raw_customers c
            WHERE c.customer_id = {{alias}}.customer_id
              AND TRY_CAST(c.join_date AS DATE) IS NOT NULL
              AND TRY_CAST(c.join_date AS DATE) <= {REF})"""

cte("stg_products", f"""
SELECT pm.customer_id,
       {_map("pm.product_name", C.PRODUCT_VARIANTS, "'Unknown'")} AS product_name,
       TRY_CAST(pm.open_date AS DATE) AS open_date,
       CASE WHEN TRY_CAST(pm.open_date AS DATE) IS NULL THEN 0
            WHEN TRY_CAST(pm.open_date AS DATE) < {INCEPTION} THEN 0
            WHEN TRY_CAST(pm.open_date AS DATE) < {_first_join_sub.format(alias="pm")} THEN 0
            ELSE 1 END AS is_valid_open_date,
       coalesce(pm.product_status, 'Unknown') AS product_status
FROM raw_products pm""", ("raw_products", "raw_customers"))

_bal = "TRY_CAST(a.avg_monthly_balance AS DOUBLE)"
_score = _int_via_float("a.credit_score")

cte("stg_activity", f"""
SELECT a.customer_id,
       {R(_bal, 2)} AS avg_monthly_balance,
       CASE WHEN {_bal} > 1000000 THEN 1 ELSE 0 END AS is_outlier_balance,
       CASE {_less_than_bands(_bal, C.BALANCE_TIERS, C.BALANCE_TOP)} AS balance_tier,
       {_score} AS credit_score,
       CASE WHEN TRY_CAST(a.credit_score AS DOUBLE) IS NULL THEN 'Unknown'
            {_less_than_bands(_score, C.CREDIT_BANDS, C.CREDIT_TOP)} AS credit_band,
       CASE WHEN regexp_full_match(trim(a.num_transactions_3m), '[+-]?[0-9]+')
            THEN TRY_CAST(a.num_transactions_3m AS INTEGER) END AS num_transactions_3m,
       {_bit("a.is_active_member")} AS is_active_member,
       TRY_CAST(a.last_txn_date AS DATE) AS last_txn_date,
       CASE WHEN TRY_CAST(a.last_txn_date AS DATE) IS NULL THEN 0
            WHEN TRY_CAST(a.last_txn_date AS DATE) < {_first_join_sub.format(alias="a")} THEN 0
            ELSE 1 END AS is_valid_last_txn,
       {_bit("a.churned")} AS churned,
       TRY_CAST(a.churn_date AS DATE) AS churn_date
FROM raw_activity a
WHERE EXISTS (SELECT 1 FROM raw_customers c WHERE c.customer_id = a.customer_id)""",
    ("raw_activity", "raw_customers"))

cte("base", """
SELECT c.customer_id, c.province, c.gender, c.age, c.age_band, c.join_date, c.tenure_days, c.tenure_band,
       c.monthly_income, c.income_tier, c.account_status, c.is_valid_join_date,
       a.churned, a.churn_date, a.avg_monthly_balance, a.balance_tier, a.credit_score, a.credit_band,
       a.num_transactions_3m, a.is_active_member, a.last_txn_date, a.is_valid_last_txn, a.is_outlier_balance
FROM stg_customers c JOIN stg_activity a ON c.customer_id = a.customer_id""", ("stg_customers", "stg_activity"))

_has = ",\n       ".join(
    f"max(CASE WHEN product_name = {_lit(p)} THEN 1 ELSE 0 END) AS has_{p.lower().replace(' ', '_')}"
    for p in C.PRODUCT_VARIANTS
)
_has_cols = ", ".join(f"has_{p.lower().replace(' ', '_')}" for p in C.PRODUCT_VARIANTS)

cte("product_counts", f"""
SELECT customer_id,
       count(*) AS total_products,
       count(CASE WHEN product_status = 'Active' THEN 1 END) AS active_products,
       count(CASE WHEN product_status = 'Closed' THEN 1 END) AS closed_products,
       {_has}
FROM stg_products GROUP BY customer_id""", ("stg_products",))

cte("churn_analysis", f"""
SELECT c.customer_id, c.first_name, c.last_name, c.date_of_birth, c.age, c.age_band, c.gender, c.province,
       c.branch_code, c.join_date, c.is_valid_join_date, c.account_status, c.tenure_days, c.tenure_band,
       c.monthly_income, c.income_tier,
       p.total_products, p.active_products, p.closed_products, {', '.join('p.' + x for x in _has_cols.split(', '))},
       a.avg_monthly_balance, a.balance_tier, a.is_outlier_balance, a.credit_score, a.credit_band,
       a.num_transactions_3m, a.is_active_member, a.last_txn_date, a.is_valid_last_txn, a.churned, a.churn_date,
       CAST(year(a.churn_date) AS INTEGER) AS churn_year,
       CAST(month(a.churn_date) AS INTEGER) AS churn_month,
       strftime(a.churn_date, '%Y-%m') AS churn_year_month,
       monthname(a.churn_date) AS churn_month_name,
       CAST(quarter(a.churn_date) AS INTEGER) AS churn_quarter
FROM stg_customers c
JOIN stg_activity a ON c.customer_id = a.customer_id
LEFT JOIN product_counts p ON c.customer_id = p.customer_id""", ("stg_customers", "stg_activity", "product_counts"))

cte("dim_customer", """
SELECT ROW_NUMBER() OVER (ORDER BY customer_id) AS customer_key,
       customer_id, first_name, last_name, date_of_birth, age, age_band, gender, province, branch_code,
       join_date, is_valid_join_date, account_status, tenure_days, tenure_band, monthly_income, income_tier
FROM stg_customers""", ("stg_customers",))

cte("dim_product", f"""
SELECT ROW_NUMBER() OVER (ORDER BY customer_id) AS product_key,
       customer_id, total_products, active_products, closed_products, {_has_cols}
FROM product_counts""", ("product_counts",))

cte("dim_date", f"""
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date
FROM generate_series(CAST({INCEPTION} AS TIMESTAMP), CAST({REF} AS TIMESTAMP), INTERVAL 1 DAY) t(d)""")

cte("fact_churn", """
SELECT ROW_NUMBER() OVER (ORDER BY a.customer_id) AS churn_fact_key,
       dc.customer_key, dp.product_key,
       CASE WHEN c.is_valid_join_date = 1 THEN CAST(strftime(c.join_date, '%Y%m%d') AS INTEGER) END AS join_date_key,
       CASE WHEN a.churn_date IS NOT NULL THEN CAST(strftime(a.churn_date, '%Y%m%d') AS INTEGER) END
           AS churn_date_key,
       a.customer_id, a.avg_monthly_balance, a.credit_score, a.num_transactions_3m, c.monthly_income,
       c.tenure_days,
       CAST(a.churned AS INTEGER) AS churned, CAST(a.is_active_member AS INTEGER) AS is_active_member,
       CAST(a.is_outlier_balance AS INTEGER) AS is_outlier_balance,
       CAST(a.is_valid_last_txn AS INTEGER) AS is_valid_last_txn,
       CAST(c.is_valid_join_date AS INTEGER) AS is_valid_join_date,
       a.balance_tier, a.credit_band, c.income_tier, c.tenure_band, c.age_band
FROM stg_activity a
JOIN stg_customers c ON a.customer_id = c.customer_id
JOIN dim_customer dc ON a.customer_id = dc.customer_id
JOIN dim_product dp ON a.customer_id = dp.customer_id""", ("stg_activity", "stg_customers", "dim_customer", "dim_product"))


def _with(deps: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in CTES[name][1]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]}\n)" for n in order) + "\n"


ORACLE_SQL: dict[str, str] = {}


def oracle(name: str, sql: str, *deps: str) -> None:
    body = sql.strip()
    prefix = _with(deps)
    if prefix and body.upper().startswith("WITH "):
        # merge the statement's own CTEs into the shared WITH list
        ORACLE_SQL[name] = prefix.rstrip() + ",\n" + body[5:]
    else:
        ORACLE_SQL[name] = prefix + body


def _rate(keys: str, table: str = "base", where: str = "", names=("total_customers", "churned", "retained",
                                                                  "churn_rate_pct")) -> str:
    s = "CAST(sum(CAST(churned AS INTEGER)) AS BIGINT)"
    sel = f"{keys}, " if keys else ""
    grp = f" GROUP BY {keys}" if keys else ""
    w = f" WHERE {where}" if where else ""
    return (f"SELECT {sel}count(*) AS {names[0]}, {s} AS {names[1]}, count(*) - {s} AS {names[2]}, "
            f"{R(f'CAST({s} AS DOUBLE) / count(*) * 100', 2)} AS {names[3]} FROM {table}{w}{grp}")


def _rows(label_table: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{label}' AS table_name, count(*) AS row_count FROM {t}"
                                for label, t in label_table)


# ------------------------------------------------------------------ load

oracle("l_01_load_customers", "SELECT * FROM raw_customers", "raw_customers")
oracle("l_02_load_products", "SELECT * FROM raw_products", "raw_products")
oracle("l_03_load_activity", "SELECT * FROM raw_activity", "raw_activity")
oracle("l_04_raw_row_counts", _rows([("raw.customers", "raw_customers"), ("raw.products", "raw_products"),
                                     ("raw.activity", "raw_activity")]),
       "raw_customers", "raw_products", "raw_activity")

# --------------------------------------------------------------- profile


def _nulls(cols: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(
        f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in cols.items()
    ) + f" FROM {table}"


CUSTOMER_NULLS = {
    "null_customer_id": "customer_id", "null_dob": "date_of_birth", "null_gender": "gender",
    "null_province": "province", "null_join_date": "join_date", "null_account_status": "account_status",
    "null_monthly_income": "monthly_income"}
ACTIVITY_NULLS = {
    "null_customer_id": "customer_id", "null_balance": "avg_monthly_balance", "null_credit_score": "credit_score",
    "null_txn_count": "num_transactions_3m", "null_active_member": "is_active_member",
    "null_last_txn": "last_txn_date", "null_churned": "churned", "null_churn_date": "churn_date"}

oracle("dq_01_customer_rows", "SELECT count(*) AS total_rows FROM raw_customers", "raw_customers")
oracle("dq_02_customer_nulls", _nulls(CUSTOMER_NULLS, "raw_customers"), "raw_customers")
oracle("dq_03a_duplicate_ids", """
SELECT customer_id, count(*) AS occurrence_count FROM raw_customers
GROUP BY customer_id HAVING count(*) > 1""", "raw_customers")
oracle("dq_03b_duplicate_rows", """
SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id
                               ORDER BY TRY_CAST(monthly_income AS DOUBLE) ASC NULLS FIRST) AS row_num
  FROM raw_customers) d
WHERE customer_id IN (SELECT customer_id FROM raw_customers GROUP BY customer_id HAVING count(*) > 1)""",
       "raw_customers")
oracle("dq_04_gender_variants", "SELECT gender, count(*) AS count FROM raw_customers GROUP BY gender",
       "raw_customers")
oracle("dq_05_province_variants", "SELECT province, count(*) AS count FROM raw_customers GROUP BY province",
       "raw_customers")
oracle("dq_06_future_join_dates", f"""
SELECT count(*) AS future_join_dates FROM raw_customers WHERE TRY_CAST(join_date AS DATE) > {REF}""",
       "raw_customers")
oracle("dq_07_income_validity", """
SELECT count(CASE WHEN TRY_CAST(monthly_income AS DOUBLE) IS NULL THEN 1 END) AS unparseable_income_value,
       count(CASE WHEN TRY_CAST(monthly_income AS DOUBLE) <= 0 THEN 1 END) AS zero_or_negative_income
FROM raw_customers""", "raw_customers")
oracle("dq_08_null_account_status", """
SELECT count(CASE WHEN account_status IS NULL THEN 1 END) AS null_account_status FROM raw_customers""",
       "raw_customers")
oracle("dq_09_product_rows", "SELECT count(*) AS total_rows FROM raw_products", "raw_products")
oracle("dq_10_product_variants",
       "SELECT product_name, count(*) AS count FROM raw_products GROUP BY product_name", "raw_products")
oracle("dq_11_null_product_status", """
SELECT count(CASE WHEN product_status IS NULL THEN 1 END) AS null_product_status FROM raw_products""",
       "raw_products")
oracle("dq_12_open_before_inception", f"""
SELECT count(*) AS suspect_open_dates FROM raw_products WHERE TRY_CAST(open_date AS DATE) < {INCEPTION}""",
       "raw_products")
_earliest = """(SELECT customer_id, min(TRY_CAST(join_date AS DATE)) AS join_date FROM raw_customers
      WHERE TRY_CAST(join_date AS DATE) IS NOT NULL GROUP BY customer_id)"""
oracle("dq_13_open_before_join", f"""
SELECT count(*) AS open_before_join FROM raw_products p
JOIN {_earliest} c ON p.customer_id = c.customer_id
WHERE TRY_CAST(p.open_date AS DATE) < c.join_date""", "raw_products", "raw_customers")
oracle("dq_14_activity_rows", "SELECT count(*) AS total_rows FROM raw_activity", "raw_activity")
oracle("dq_15_activity_nulls", _nulls(ACTIVITY_NULLS, "raw_activity"), "raw_activity")
oracle("dq_16_orphan_activity", """
SELECT count(*) AS orphan_records FROM raw_activity a
WHERE NOT EXISTS (SELECT 1 FROM raw_customers c WHERE c.customer_id = a.customer_id)""",
       "raw_activity", "raw_customers")
oracle("dq_17_txn_before_join", f"""
SELECT count(*) AS txn_before_join FROM raw_activity a
JOIN {_earliest} c ON a.customer_id = c.customer_id
WHERE TRY_CAST(a.last_txn_date AS DATE) < c.join_date""", "raw_activity", "raw_customers")
oracle("dq_18_churn_date_integrity", """
SELECT count(CASE WHEN churned = '1' AND churn_date IS NOT NULL THEN 1 END) AS churned_with_date,
       count(CASE WHEN churned = '0' AND churn_date IS NULL THEN 1 END) AS not_churned_without_date,
       count(CASE WHEN churned = '1' AND churn_date IS NULL THEN 1 END) AS churned_missing_date,
       count(CASE WHEN churned = '0' AND churn_date IS NOT NULL THEN 1 END) AS not_churned_has_date
FROM raw_activity""", "raw_activity")
oracle("dq_19_credit_score_range", f"""
SELECT count(CASE WHEN {_int_via_float("credit_score")} < 300 THEN 1 END) AS below_minimum,
       count(CASE WHEN {_int_via_float("credit_score")} > 850 THEN 1 END) AS above_maximum
FROM raw_activity WHERE TRY_CAST(credit_score AS DOUBLE) IS NOT NULL""", "raw_activity")

_fint = _int_via_float("credit_score")
_LOG = (
    [("DQ-01", "total_rows", "SELECT count(*) FROM raw_customers")]
    + [("DQ-02", m, f"SELECT sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM raw_customers")
       for m, c in CUSTOMER_NULLS.items()]
    + [("DQ-03", "duplicate_ids",
        "SELECT count(*) FROM (SELECT customer_id FROM raw_customers GROUP BY customer_id HAVING count(*) > 1)"),
       ("DQ-04", "gender_variants", "SELECT count(*) FROM (SELECT DISTINCT gender FROM raw_customers)"),
       ("DQ-05", "province_variants", "SELECT count(*) FROM (SELECT DISTINCT province FROM raw_customers)"),
       ("DQ-06", "future_join_dates", f"SELECT count(*) FROM raw_customers WHERE TRY_CAST(join_date AS DATE) > {REF}"),
       ("DQ-07", "unparseable_income_value",
        "SELECT count(*) FROM raw_customers WHERE TRY_CAST(monthly_income AS DOUBLE) IS NULL"),
       ("DQ-07", "zero_or_negative_income",
        "SELECT count(*) FROM raw_customers WHERE TRY_CAST(monthly_income AS DOUBLE) <= 0"),
       ("DQ-08", "null_account_status", "SELECT count(*) FROM raw_customers WHERE account_status IS NULL"),
       ("DQ-09", "total_rows", "SELECT count(*) FROM raw_products"),
       ("DQ-10", "product_name_variants", "SELECT count(*) FROM (SELECT DISTINCT product_name FROM raw_products)"),
       ("DQ-11", "null_product_status", "SELECT count(*) FROM raw_products WHERE product_status IS NULL"),
       ("DQ-12", "suspect_open_dates",
        f"SELECT count(*) FROM raw_products WHERE TRY_CAST(open_date AS DATE) < {INCEPTION}"),
       ("DQ-13", "open_before_join", f"SELECT count(*) FROM raw_products p JOIN {_earliest} c "
                                     "ON p.customer_id = c.customer_id WHERE TRY_CAST(p.open_date AS DATE) < c.join_date"),
       ("DQ-14", "total_rows", "SELECT count(*) FROM raw_activity")]
    + [("DQ-15", m, f"SELECT sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM raw_activity")
       for m, c in ACTIVITY_NULLS.items()]
    + [("DQ-16", "orphan_records", "SELECT count(*) FROM raw_activity a WHERE NOT EXISTS "
                                   "(SELECT 1 FROM raw_customers c WHERE c.customer_id = a.customer_id)"),
       ("DQ-17", "txn_before_join", f"SELECT count(*) FROM raw_activity a JOIN {_earliest} c "
                                    "ON a.customer_id = c.customer_id "
                                    "WHERE TRY_CAST(a.last_txn_date AS DATE) < c.join_date"),
       ("DQ-18", "churned_with_date",
        "SELECT count(*) FROM raw_activity WHERE churned = '1' AND churn_date IS NOT NULL"),
       ("DQ-18", "not_churned_without_date",
        "SELECT count(*) FROM raw_activity WHERE churned = '0' AND churn_date IS NULL"),
       ("DQ-18", "churned_missing_date", "SELECT count(*) FROM raw_activity WHERE churned = '1' AND churn_date IS NULL"),
       ("DQ-18", "not_churned_has_date",
        "SELECT count(*) FROM raw_activity WHERE churned = '0' AND churn_date IS NOT NULL"),
       ("DQ-19", "below_minimum", f"SELECT count(*) FROM raw_activity WHERE {_fint} < 300"),
       ("DQ-19", "above_maximum", f"SELECT count(*) FROM raw_activity WHERE {_fint} > 850")]
)
# the export of the fixture tables holds no malformed row
_LOG += [("L-04", f"malformed_{t}_rows", "SELECT 0") for t in ("customers", "products", "activity")]
oracle("dq_00_quality_log", "\nUNION ALL\n".join(
    f"SELECT '{cid}' AS check_id, '{C.CHECK_SEVERITY.get(cid, C.MALFORMED_SEVERITY)}' AS severity, '{metric}' AS metric, "
    f"CAST(({q}) AS BIGINT) AS value" for cid, metric, q in _LOG), "raw_customers", "raw_products", "raw_activity")

# --------------------------------------------------------------- staging

oracle("st_01_dedupe_customers", """
SELECT customer_id, first_name, last_name, date_of_birth, gender, province, branch_code, join_date,
       account_status, monthly_income
FROM dedup WHERE row_num = 1 AND customer_id IS NOT NULL""", "dedup")
oracle("st_11_staging_customers", "SELECT * FROM stg_customers", "stg_customers")
oracle("st_14_staging_products", "SELECT * FROM stg_products", "stg_products")
oracle("st_20_staging_activity", "SELECT * FROM stg_activity", "stg_activity")
oracle("v_01_staging_row_counts", _rows([("staging.customers", "stg_customers"),
                                         ("staging.products", "stg_products"),
                                         ("staging.activity", "stg_activity")]),
       "stg_customers", "stg_products", "stg_activity")
oracle("v_02_province_counts", "SELECT province, count(*) AS count FROM stg_customers GROUP BY province",
       "stg_customers")
oracle("v_03_gender_counts", "SELECT gender, count(*) AS count FROM stg_customers GROUP BY gender",
       "stg_customers")
oracle("v_04_product_counts", "SELECT product_name, count(*) AS count FROM stg_products GROUP BY product_name",
       "stg_products")
oracle("v_05_duplicates_after_dedupe", """
SELECT customer_id, count(*) AS occurrence_count FROM stg_customers GROUP BY customer_id HAVING count(*) > 1""",
       "stg_customers")
oracle("v_06_active_member_counts",
       "SELECT is_active_member, count(*) AS count FROM stg_activity GROUP BY is_active_member", "stg_activity")
oracle("v_07_churned_counts", "SELECT churned, count(*) AS count FROM stg_activity GROUP BY churned",
       "stg_activity")

# -------------------------------------------------------------- analysis

oracle("eda_00_base", "SELECT * FROM base", "base")
oracle("eda_01_overall_rate", _rate("", names=("total_customers", "total_churned", "total_retained",
                                               "churn_rate_pct")), "base")
oracle("eda_02_rate_by_province", _rate("province"), "base")
oracle("eda_03_rate_by_gender", _rate("gender"), "base")
oracle("eda_04_rate_by_age_band", _rate("age_band", where="age_band != 'Unknown'"), "base")
oracle("eda_05_account_status_share", f"""
SELECT account_status, count(*) AS total_customers,
       {R("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100", 2)} AS pct_of_total
FROM base GROUP BY account_status""", "base")
oracle("eda_06_new_customers_by_year", """
SELECT CAST(year(join_date) AS INTEGER) AS join_year, count(*) AS new_customers
FROM base WHERE is_valid_join_date = 1 GROUP BY year(join_date)""", "base")


def _summary_sql(key: str, col: str, digits: int, suffix: str, where: str) -> str:
    """Grouped statistics; a NULL key matches no group and is left out."""
    v = f"CAST({col} AS DOUBLE)"
    cond = f"{key} IS NOT NULL AND churned IS NOT NULL" + (f" AND {where}" if where else "")
    return f"""
SELECT {key}, churned, count(*) AS customer_count,
       {R(f"min({v})", digits)} AS min_{suffix},
       {R(f"max({v})", digits)} AS max_{suffix},
       {R(f"avg({v})", digits)} AS avg_{suffix},
       {R(f"stddev_samp({v})", digits)} AS stdev_{suffix},
       {R(f"quantile_cont({v}, 0.5)", digits)} AS median_{suffix}
FROM base
WHERE {cond}
GROUP BY {key}, churned"""


oracle("eda_07_income_summary", _summary_sql("income_tier", "monthly_income", 0, "income",
                                             "monthly_income IS NOT NULL AND income_tier != 'Unknown'"), "base")
oracle("eda_08_rate_by_income_tier", _rate("income_tier", where="income_tier != 'Unknown'"), "base")
oracle("eda_09_product_status_share", f"""
SELECT p.product_status, count(*) AS total_products,
       {R("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100", 2)} AS pct_of_total
FROM base b JOIN stg_products p ON b.customer_id = p.customer_id
GROUP BY p.product_status""", "base", "stg_products")
oracle("eda_10_products_per_customer", f"""
SELECT product_count, count(*) AS customer_count,
       {R("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100", 2)} AS pct_of_customers
FROM (SELECT b.customer_id, count(p.product_name) AS product_count
      FROM base b JOIN stg_products p ON b.customer_id = p.customer_id
      GROUP BY b.customer_id) sub
GROUP BY product_count""", "base", "stg_products")
oracle("eda_11_rate_by_product_count", _rate("product_count", table="""(
      SELECT b.customer_id, b.churned, count(p.product_name) AS product_count
      FROM base b JOIN stg_products p ON b.customer_id = p.customer_id
      GROUP BY b.customer_id, b.churned) sub"""), "base", "stg_products")
oracle("eda_12_rate_by_product", f"""
SELECT p.product_name, count(DISTINCT b.customer_id) AS total_customers,
       count(DISTINCT CASE WHEN b.churned = 1 THEN b.customer_id END) AS churned_customers,
       {R("CAST(count(DISTINCT CASE WHEN b.churned = 1 THEN b.customer_id END) AS DOUBLE) "
          "/ count(DISTINCT b.customer_id) * 100", 2)} AS churn_rate_pct
FROM base b JOIN stg_products p ON b.customer_id = p.customer_id
GROUP BY p.product_name""", "base", "stg_products")
oracle("eda_13_balance_summary", _summary_sql("balance_tier", "avg_monthly_balance", 2, "balance", ""), "base")
oracle("eda_14_rate_by_balance_tier", _rate("balance_tier"), "base")
oracle("eda_15_credit_summary", _summary_sql("credit_band", "credit_score", 0, "score",
                                             "credit_score IS NOT NULL AND credit_band != 'Unknown'"), "base")
oracle("eda_16_rate_by_credit_band", _rate("credit_band", where="credit_band != 'Unknown'"), "base")
oracle("eda_17_rate_by_active_member", _rate("is_active_member"), "base")
_txn = "CASE WHEN num_transactions_3m = 0 THEN 'No Activity' " + _less_than_bands(
    "num_transactions_3m", C.TXN_BANDS, C.TXN_TOP)
oracle("eda_18_rate_by_txn_band", _rate("txn_band", table=f"""(
      SELECT churned, {_txn} AS txn_band FROM base WHERE num_transactions_3m IS NOT NULL) sub"""), "base")
oracle("eda_19_rate_by_tenure_band", _rate("tenure_band", where="tenure_band != 'Unknown'"), "base")
oracle("eda_20_top_at_risk", f"""
SELECT customer_id, province, age, {R("avg_monthly_balance", 0)} AS avg_balance, num_transactions_3m,
       is_active_member, credit_band, tenure_days, income_tier
FROM base
WHERE churned = 0 AND avg_monthly_balance > 50000 AND is_active_member = 0 AND num_transactions_3m < 5
  AND is_outlier_balance = 0
ORDER BY avg_monthly_balance DESC, customer_id
LIMIT 20""", "base")
oracle("eda_21_monthly_churn", """
SELECT strftime(churn_date, '%Y-%m') AS churn_month, count(*) AS churned_customers
FROM base WHERE churn_date IS NOT NULL GROUP BY strftime(churn_date, '%Y-%m')""", "base")
oracle("eda_22_quarterly_churn", """
SELECT CAST(year(churn_date) AS INTEGER) AS churn_year, CAST(quarter(churn_date) AS INTEGER) AS churn_quarter,
       count(*) AS churned_customers
FROM base WHERE churn_date IS NOT NULL GROUP BY year(churn_date), quarter(churn_date)""", "base")
oracle("eda_23_annual_churn_change", f"""
SELECT churn_year, churned_customers, prior_year_churned,
       churned_customers - prior_year_churned AS yoy_change,
       {R("CAST(churned_customers - prior_year_churned AS DOUBLE) / prior_year_churned * 100", 2)} AS yoy_change_pct
FROM (SELECT churn_year, churned_customers,
             LAG(churned_customers) OVER (ORDER BY churn_year) AS prior_year_churned
      FROM (SELECT CAST(year(churn_date) AS INTEGER) AS churn_year, count(*) AS churned_customers
            FROM base WHERE churn_date IS NOT NULL GROUP BY year(churn_date)) y) t""", "base")
oracle("eda_24_churn_by_month_of_year", """
SELECT CAST(month(churn_date) AS INTEGER) AS churn_month_number, monthname(churn_date) AS churn_month_name,
       count(*) AS churned_customers
FROM base WHERE churn_date IS NOT NULL GROUP BY month(churn_date), monthname(churn_date)""", "base")
_inc = "CAST(monthly_income AS DOUBLE)"
oracle("eda_25_mean_median_gap", f"""
SELECT {R(f"avg({_inc})", 0)} AS mean_income,
       {R(f"quantile_cont({_inc}, 0.5)", 0)} AS median_income,
       {R(f"avg({_inc})", 0)} - {R(f"quantile_cont({_inc}, 0.5)", 0)} AS income_mean_median_gap,
       {R("avg(avg_monthly_balance)", 2)} AS mean_balance,
       {R("quantile_cont(avg_monthly_balance, 0.5)", 2)} AS median_balance,
       {R("avg(avg_monthly_balance)", 2)} - {R("quantile_cont(avg_monthly_balance, 0.5)", 2)}
           AS balance_mean_median_gap
FROM base WHERE monthly_income IS NOT NULL""", "base")
oracle("eda_26_balance_deciles", f"""
SELECT balance_decile, count(*) AS customer_count, {R("sum(avg_monthly_balance)", 0)} AS total_balance,
       {R("sum(avg_monthly_balance) / sum(sum(avg_monthly_balance)) OVER () * 100", 2)} AS pct_of_total_balance
FROM (SELECT avg_monthly_balance,
             CAST(NTILE(10) OVER (ORDER BY avg_monthly_balance DESC NULLS LAST, customer_id) AS INTEGER)
                 AS balance_decile
      FROM base WHERE is_outlier_balance = 0) t
GROUP BY balance_decile""", "base")
_rate_expr = R("CAST(sum(CAST(churned AS INTEGER)) AS DOUBLE) / count(*) * 100", 2)
oracle("eda_27_outlier_sensitivity", f"""
SELECT 'Including top 1%' AS dataset, count(*) AS customer_count,
       {R("avg(avg_monthly_balance)", 2)} AS mean_balance, {_rate_expr} AS churn_rate_pct
FROM base
UNION ALL
SELECT 'Excluding top 1%', count(*), {R("avg(avg_monthly_balance)", 2)}, {_rate_expr}
FROM base
WHERE avg_monthly_balance < (SELECT quantile_cont(avg_monthly_balance, 0.99) FROM base)""", "base")

# ------------------------------------------------------------ wide table

oracle("w_01_product_portfolio", "SELECT * FROM product_counts", "product_counts")
oracle("w_02_churn_analysis", "SELECT * FROM churn_analysis", "churn_analysis")
oracle("v_08_wide_rows", "SELECT count(*) AS total_rows FROM churn_analysis", "churn_analysis")
oracle("v_09_wide_duplicates", """
SELECT customer_id, count(*) AS occurrence_count FROM churn_analysis GROUP BY customer_id HAVING count(*) > 1""",
       "churn_analysis")
oracle("v_10_wide_by_churned",
       "SELECT churned, count(*) AS customer_count FROM churn_analysis GROUP BY churned", "churn_analysis")
oracle("v_11_wide_by_products",
       "SELECT total_products, count(*) AS customer_count FROM churn_analysis GROUP BY total_products",
       "churn_analysis")
oracle("v_12_wide_by_province",
       "SELECT province, count(*) AS customer_count FROM churn_analysis GROUP BY province", "churn_analysis")
oracle("v_13_churn_date_range", """
SELECT min(churn_date) AS earliest_churn, max(churn_date) AS latest_churn
FROM churn_analysis WHERE churn_date IS NOT NULL""", "churn_analysis")

# ----------------------------------------------------------- star schema

oracle("ss_1_dim_customer", "SELECT * FROM dim_customer", "dim_customer")
oracle("ss_2_dim_product", "SELECT * FROM dim_product", "dim_product")
# Week numbers from strftime's Sunday weeks, in which the days before the year's first Sunday are week 0.
oracle("ss_3_calendar_use", f"""
SELECT CAST(u.day AS INTEGER) AS date_key, d AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month_number,
  monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter, 'Q' || quarter(d) || ' ' || year(d) AS quarter_label,
  strftime(d, '%Y-%m') AS year_month,
  CAST(strftime(d, '%U') AS INTEGER) + CASE WHEN dayofweek(make_date(year(d), 1, 1)) = 0 THEN 0 ELSE 1 END AS week_number,
  CAST(isodow(d) % 7 + 1 AS INTEGER) AS day_of_week_number, dayname(d) AS day_of_week_name, CAST(day(d) AS INTEGER) AS day_of_month,
  CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend, CAST(month(d + INTERVAL 1 DAY) <> month(d) AS INTEGER) AS is_month_end, u.joined_rows, u.churned_rows
FROM (
  SELECT day, count(*) FILTER (use = 'join') AS joined_rows, count(*) FILTER (use = 'churn') AS churned_rows
  FROM (SELECT join_date_key AS day, 'join' AS use FROM fact_churn UNION ALL SELECT churn_date_key, 'churn' FROM fact_churn)
  WHERE day IS NOT NULL GROUP BY day
) u LEFT JOIN (
  SELECT CAST(x AS DATE) AS d FROM range(TIMESTAMP '{C.FIXTURE.calendar_start}', TIMESTAMP '{C.FIXTURE.calendar_end}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(x)
) c ON CAST(strftime(c.d, '%Y%m%d') AS INTEGER) = u.day""", "fact_churn")
oracle("ss_4_fact_churn", "SELECT * FROM fact_churn", "fact_churn")
oracle("v_14_star_row_counts", _rows([("staging.dim_customer", "dim_customer"),
                                      ("staging.dim_product", "dim_product"),
                                      ("staging.dim_date", "dim_date"), ("staging.fact_churn", "fact_churn")]),
       "dim_customer", "dim_product", "dim_date", "fact_churn")
oracle("v_15_fact_rows", "SELECT count(*) AS fact_churn_rows FROM fact_churn", "fact_churn")
oracle("v_16_wide_rows", "SELECT count(*) AS churn_analysis_rows FROM churn_analysis", "churn_analysis")
oracle("v_17_unmatched_customer_keys", """
SELECT count(*) AS unmatched_customer_keys FROM fact_churn f
WHERE NOT EXISTS (SELECT 1 FROM dim_customer d WHERE d.customer_key = f.customer_key)""",
       "fact_churn", "dim_customer")
oracle("v_18_unmatched_product_keys", """
SELECT count(*) AS unmatched_product_keys FROM fact_churn f
WHERE NOT EXISTS (SELECT 1 FROM dim_product d WHERE d.product_key = f.product_key)""",
       "fact_churn", "dim_product")
oracle("v_19_unmatched_join_date_keys", """
SELECT count(*) AS unmatched_join_date_keys FROM fact_churn f
WHERE join_date_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_date d WHERE d.date_key = f.join_date_key)""",
       "fact_churn", "dim_date")
oracle("v_20_unmatched_churn_date_keys", """
SELECT count(*) AS unmatched_churn_date_keys FROM fact_churn f
WHERE churn_date_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_date d WHERE d.date_key = f.churn_date_key)""",
       "fact_churn", "dim_date")
oracle("v_21_reconcile_rate", f"""
SELECT 'fact_churn' AS source, count(*) AS total_customers, CAST(sum(churned) AS BIGINT) AS total_churned,
       {R("CAST(sum(churned) AS DOUBLE) / count(*) * 100", 2)} AS churn_rate_pct
FROM fact_churn
UNION ALL
SELECT 'churn_analysis', count(*), CAST(sum(CAST(churned AS INTEGER)) AS BIGINT),
       {R("CAST(sum(CAST(churned AS INTEGER)) AS DOUBLE) / count(*) * 100", 2)}
FROM churn_analysis""", "fact_churn", "churn_analysis")
