"""Semantic roles, business domain and capabilities: rules over profile rows (one row a column of the table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords of each role, matched as whole words in this order.
ROLE_WORDS: dict[str, list[str]] = {
    "date": ["date", "time", "datetime", "created", "updated", "joined", "invoice date", "order date"],
    "payment_method": ["payment", "cash", "card", "cash_type", "pay", "method"],
    "product": ["product", "item", "coffee", "sku", "service", "menu", "product name", "item name"],
    "customer": ["customer", "client", "buyer"],
    "employee": ["employee", "staff", "worker"],
    "location": ["region", "city", "country", "branch", "location", "area"],
    "status": ["status", "state", "stage", "progress"],
    "quantity": ["qty", "quantity", "units", "count", "stock", "volume"],
    "money": ["money", "amount", "revenue", "sales", "price", "cost", "fee", "salary", "value", "total"],
    "id": ["id", "number", "no", "code", "reference", "invoice", "order_id"],
}
# Keywords of role correction, matched in this order, and the confidence of each.
CORRECTIONS: list[tuple[str, float, list[str]]] = [
    ("date", 0.90, ["date", "time", "datetime", "created", "closed", "joined", "join"]),
    ("product", 0.90, ["coffee", "product", "item", "sku", "menu"]),
    ("payment_method", 0.90, ["cash", "payment", "card", "method"]),
    ("quantity", 0.88, ["qty", "quantity", "units", "stock", "count"]),
    ("money", 0.90, ["money", "amount", "sales", "revenue", "price", "cost", "salary"]),
    ("location", 0.85, ["region", "city", "country", "branch", "location"]),
    ("category", 0.82, ["department", "category", "supplier"]),
    ("status", 0.82, ["status"]),
    ("identifier", 0.78, ["id", "uuid", "code", "number", "no"]),
]
# Substrings of names -> semantic role, business role, confidence.
SEMANTICS: list[tuple[str, str, float, list[str]]] = [
    ("date_or_timestamp", "time", 0.80, ["date", "time", "datetime", "created", "closed", "joined", "join"]),
    ("financial_amount", "measure", 0.82, ["money", "amount", "sales", "revenue", "price", "cost", "salary"]),
    ("quantity", "measure", 0.82, ["qty", "quantity", "count", "units", "stock"]),
    ("product_or_item", "dimension", 0.82, ["product", "item", "coffee", "sku"]),
    ("payment_method_or_type", "dimension", 0.78, ["payment", "cash", "card", "method", "type"]),
    ("location", "dimension", 0.78, ["region", "city", "country", "branch", "location"]),
    ("business_category", "dimension", 0.75, ["department", "status", "category", "supplier"]),
]
# Words of column names that speak for a domain, and their points.
DOMAIN_WORDS: list[tuple[str, int, list[str]]] = [
    ("hr", 3, ["employee", "salary", "department", "join"]),
    ("inventory", 3, ["stock", "sku", "supplier", "inventory", "reorder"]),
    ("finance", 2, ["invoice", "expense", "account", "budget"]),
]
DOMAINS = ["sales_or_transactions", "hr", "inventory", "finance", "operations"]
# Name words of broad domains, tried in this order.
BROAD_DOMAINS: list[tuple[str, float, list[str]]] = [
    ("sales_transactions", 0.75, ["coffee", "product", "qty", "quantity", "price", "money", "sales", "revenue", "cash", "payment"]),
    ("hr", 0.70, ["employee", "salary", "department", "join", "hire", "status"]),
    ("inventory", 0.70, ["stock", "inventory", "sku", "supplier", "reorder", "unit_cost"]),
    ("operations_or_support", 0.65, ["ticket", "issue", "priority", "closed", "opened", "resolved"]),
]


def _plain(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def _has_word(name: Column, words: list[str]) -> Column:
    phrases = "|".join(w.replace("_", " ") for w in words)
    return _plain(name).rlike(rf"(^|\s)(?:{phrases})($|\s)")


def _has_part(name: Column, parts: list[str]) -> Column:
    return F.lower(name).rlike("|".join(parts))


def _first(cases: list[tuple[Column, tuple]], otherwise: tuple) -> list[Column]:
    """One column for each place of the result tuples: those of the first case that holds."""
    out = [x if isinstance(x, Column) else F.lit(x) for x in otherwise]
    for test, values in reversed(cases):
        out = [F.when(test, v).otherwise(o) for v, o in zip(values, out)]
    return out


def guess_roles(profile: DataFrame) -> DataFrame:
    """profile with role_guess and role_confidence; ratio rules use the unrounded ratio."""
    name, kind, ratio = F.col("name"), F.col("detected_type"), F.col("exact_ratio")
    cases = [(_has_word(name, words), (role, 0.90)) for role, words in ROLE_WORDS.items()]
    cases += [(kind == "datetime", ("date", 0.85)), ((kind == "number") & (ratio < 0.05), ("numeric_category", 0.55)), (kind == "number", ("measure", 0.70)), ((kind == "text") & (ratio <= 0.25), ("dimension", 0.75)), (kind == "text", ("text", 0.60))]
    role, sure = _first(cases, ("unknown", 0.40))
    return profile.withColumns({"role_guess": role, "role_confidence": sure})


def correct_roles(roles: DataFrame, match: str = "substring") -> DataFrame:
    """roles with corrected_role and corrected_confidence. match="word" compares whole words, so that `country` is no count."""
    has = {"substring": _has_part, "word": _has_word}[match]
    cases = [(has(F.col("name"), words), (role, sure)) for role, sure, words in CORRECTIONS]
    cases.append(((F.col("detected_type") == "number") & (F.col("role_guess") == "unknown"), ("measure", F.greatest("role_confidence", F.lit(0.65)))))
    role, sure = _first(cases, (F.col("role_guess"), F.col("role_confidence")))
    return roles.withColumns({"corrected_role": role, "corrected_confidence": sure})


def semantic_roles(roles: DataFrame) -> DataFrame:
    """roles with semantic_role, business_role and semantic_confidence, by rules on names."""
    cases = [(_has_part(F.col("name"), words), (role, business, sure)) for role, business, sure, words in SEMANTICS]
    cases += [(F.col("detected_type") == "number", ("numeric_measure", "measure", 0.65)), (F.col("role_guess") == "dimension", ("categorical_dimension", "dimension", 0.65))]
    role, business, sure = _first(cases, (F.col("role_guess"), "unknown", 0.55))
    return roles.withColumns({"semantic_role": role, "business_role": business, "semantic_confidence": sure})


def _any(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def _any_role(*names: str) -> Column:
    return _any(F.col("role_guess").isin(*names))


def domain_scores(roles: DataFrame) -> DataFrame:
    """One row: a score for every domain, possible_business_domain (the first of the highest; unknown if all are 0)."""
    sales = F.when(_any_role("date") & _any_role("money"), 2).otherwise(0) + F.when(_any_role("product"), 2).otherwise(0) + F.when(_any_role("payment_method"), 1).otherwise(0)
    scores = {"sales_or_transactions": sales} | {d: F.when(_any(_has_part(F.col("name"), words)), n).otherwise(0) for d, n, words in DOMAIN_WORDS} | {"operations": F.lit(0)}
    row = roles.agg(*[scores[d].alias(d) for d in DOMAINS])
    best = F.greatest(*DOMAINS)
    chosen = F.coalesce(*[F.when((F.col(d) == best) & (best > 0), d) for d in DOMAINS], F.lit("unknown"))
    return row.withColumn("possible_business_domain", chosen)


def broad_domain(roles: DataFrame) -> DataFrame:
    """One row: possible_business_domain and domain_confidence by words of the column names."""
    row = roles.agg(*[_any(_has_part(F.col("name"), words)).alias(d) for d, _, words in BROAD_DOMAINS])
    name, sure = _first([(F.col(d), (d, c)) for d, c, _ in BROAD_DOMAINS], ("general_business_dataset", 0.50))
    return row.select(name.alias("possible_business_domain"), sure.alias("domain_confidence"))


def capabilities(roles: DataFrame) -> DataFrame:
    """One row of flags: which analyses the roles allow."""
    price = _any(_has_part(F.col("name"), ["price"]))
    flags = {
        "time_analysis": _any_role("date"),
        "money_analysis": _any_role("money", "measure"),
        "product_analysis": _any_role("product", "dimension"),
        "payment_method_analysis": _any_role("payment_method"),
        "location_analysis": _any_role("location"),
        "status_analysis": _any_role("status"),
        "quantity_price_revenue_possible": _any_role("quantity") & (_any_role("money") | price),
        "category_comparison": _any_role("dimension", "product", "location", "payment_method", "status"),
    }
    return roles.agg(*[c.alias(n) for n, c in flags.items()])


def broad_capabilities(roles: DataFrame) -> DataFrame:
    """One row of flags by types, roles and words of names, for tables without a model's help."""
    def named(*parts: str) -> Column:
        return _any(_has_part(F.col("name"), list(parts)))

    flags = {
        "time_analysis": _any(F.col("detected_type") == "date") | _any_role("date") | named("date", "time", "datetime", "created", "closed"),
        "measure_analysis": _any(F.col("detected_type") == "number") | _any_role("measure"),
        "category_analysis": _any_role("dimension") | named("product", "category", "region", "branch", "department", "status", "type", "method"),
        "sales_analysis": named("money", "amount", "sales", "revenue", "price", "cost", "salary"),
        "product_analysis": named("product", "item", "coffee", "sku", "name"),
        "payment_method_analysis": named("payment", "cash", "card", "method"),
        "status_analysis": named("status"),
        "hr_analysis": named("employee", "staff", "department", "salary"),
        "inventory_analysis": named("stock", "inventory", "sku", "reorder", "supplier"),
    }
    return roles.agg(*[c.alias(n) for n, c in flags.items()])


def safe_metadata(roles: DataFrame) -> DataFrame:
    """What may leave the house: names, types, roles, shares and counts, and no value of the table."""
    return correct_roles(roles).select("name", "detected_type", F.col("corrected_role").alias("role_guess"), F.col("corrected_confidence").alias("role_confidence"), "missing_percent", "unique_count")
