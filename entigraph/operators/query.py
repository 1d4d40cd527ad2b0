"""Declarative reads: filters, ordering, paging, and the joins that list views need."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "contains": lambda c, v: F.contains(F.lower(c.cast("string")), F.lower(F.lit(v))),
    "in": lambda c, v: c.isin(*v),
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "ilike": lambda c, v: c.ilike(f"%{v}%"),
    "has": lambda c, v: F.array_contains(c, v),
}


def predicate(column: str, operator: str, value: object) -> Column:
    """A filter of the algebra eq, ne, gt, lt, gte, lte, contains, in, is_null, ilike, has."""
    if operator not in _OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; known: {sorted(_OPERATORS)}")
    return _OPERATORS[operator](F.col(column), value)


@dataclass(frozen=True)
class QuerySpec:
    """Select list, filters (column, operator, value), order (column, descending) and page.

    ``key`` breaks ties, so pages are stable."""

    select: tuple[str, ...] = ()
    where: tuple[tuple[str, str, object], ...] = ()
    any_of: tuple[tuple[str, str, object], ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    key: str = "id"
    offset: int = 0
    limit: int | None = 1000

    def filtered(self, df: DataFrame) -> DataFrame:
        for f in self.where:
            df = df.where(predicate(*f))
        if self.any_of:
            either = predicate(*self.any_of[0])
            for f in self.any_of[1:]:
                either = either | predicate(*f)
            df = df.where(either)
        return df

    def page(self, df: DataFrame) -> DataFrame:
        df = self.filtered(df)
        if self.order or self.limit is not None:
            df = df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in self.order], F.asc(self.key))
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None:
            df = df.limit(self.limit)
        return df.select(*self.select) if self.select else df

    def totals(self, df: DataFrame) -> DataFrame:
        """(total, has_more) of the filters, apart from the page."""
        shown = self.offset + (self.limit or 0)
        return self.filtered(df).agg(F.count("*").alias("total")).withColumn("has_more", F.lit(self.limit is not None) & (F.col("total") > shown))


@dataclass(frozen=True)
class EntitySearch:
    """Search over entities or relationships by type, confidence, verification and text."""

    types: tuple[str, ...] = ()
    type_column: str = "entity_type"
    min_confidence: float = 0.0
    verified_only: bool = False
    text: str = ""
    extra: tuple[tuple[str, str, object], ...] = field(default=())

    def spec(self, offset: int = 0, limit: int | None = 100) -> QuerySpec:
        where: list[tuple[str, str, object]] = [("is_active", "eq", True)]
        if self.types:
            where.append((self.type_column, "in", self.types))
        if self.min_confidence > 0:
            where.append(("confidence", "gte", self.min_confidence))
        if self.verified_only:
            where.append(("is_verified", "eq", True))
        if self.text:
            where.append(("entity_text", "ilike", self.text))
        return QuerySpec(where=(*where, *self.extra), order=(("confidence", True),), offset=offset, limit=limit)


def having_edge(entities: DataFrame, relationships: DataFrame, kind: str, direction: str = "out", other: DataFrame | None = None) -> DataFrame:
    """Entities with an edge of a type, outwards, inwards or either way, to a row of ``other``."""
    edges = relationships.where(F.col("relationship_type") == kind)
    out = edges.select(F.col("source_entity_id").alias("own"), F.col("target_entity_id").alias("far"))
    into = edges.select(F.col("target_entity_id").alias("own"), F.col("source_entity_id").alias("far"))
    pairs = {"out": out, "in": into, "both": out.unionAll(into)}[direction]
    if other is not None:
        pairs = pairs.join(other.select(F.col("id").alias("far")), "far", "left_semi")
    return entities.join(pairs, entities.id == pairs.own, "left_semi")


def with_endpoints(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with source_text, source_type, target_text and target_type."""
    end = lambda p: entities.select(F.col("id").alias(f"{p}_entity_id"), F.col("entity_text").alias(f"{p}_text"), F.col("entity_type").alias(f"{p}_type"))
    return relationships.join(end("source"), "source_entity_id", "left").join(end("target"), "target_entity_id", "left")


def forbidden_words(statement: str) -> list[str]:
    """Why a user's statement is refused: it must be one query that reads.

    Decided on the statement's first keyword, not on letters inside it."""
    first = statement.strip().split(None, 1)[0].upper() if statement.strip() else ""
    return [] if first in ("SELECT", "WITH", "FROM", "VALUES", "TABLE") and ";" not in statement.strip().rstrip(";") else [first or "empty"]


def read_only_sql(spark, statement: str, limit: int = 1000, **views: DataFrame) -> DataFrame:
    """Run a user's query over the given views, cut to ``limit`` rows."""
    refused = forbidden_words(statement)
    if refused:
        raise ValueError(f"only queries that read are allowed, not {refused[0]}")
    return spark.sql(statement.replace("{", "{{").replace("}", "}}") if not views else statement, **views).limit(limit)


def permission_names(user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user_id, name, resource) for each user's permissions."""
    return user_roles.join(role_permissions, "role_id").join(permissions, "permission_id").select("user_id", "name", F.split("name", ":")[0].alias("resource")).distinct()


def visible(rows: DataFrame, grants: DataFrame, user: object, owner: str, resource: str, public: Column | None = None) -> DataFrame:
    """Rows that a user may see: all if granted on the resource, else their own and the public ones."""
    granted = grants.where((F.col("user_id") == user) & (F.col("resource") == resource))
    may = F.col(owner) == user
    if public is not None:
        may = may | public
    return rows.where(F.coalesce(may, F.lit(False)) | F.lit(not granted.isEmpty()))
