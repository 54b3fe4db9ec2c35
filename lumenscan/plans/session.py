"""A session: named datasets with their history, batches of cleaning operations, undo, queries and sources."""

from __future__ import annotations

import inspect
import math
import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..operators import clean, issues, profile, relations
from ..sources import files, tables
from . import expressions, guard, response

MOST_SNAPSHOTS = 10
MOST_GROUPS = 50
# Fixed value: least share of the variance, and greatest probability, of a difference of groups.
LEAST_EFFECT = 0.01


@dataclass
class Operation:
    description: str
    rows_before: int
    rows_after: int
    undoable: bool = True


@dataclass
class Dataset:
    alias: str
    df: DataFrame
    origin: str
    history: list[Operation] = field(default_factory=list)
    snapshots: list[DataFrame] = field(default_factory=list)

    def commit(self, df: DataFrame, operation: Operation) -> None:
        """Snapshots are plans, not copies; the oldest beyond the limit can no longer be undone."""
        self.snapshots.append(self.df)
        self.history.append(operation)
        if len(self.snapshots) > MOST_SNAPSHOTS:
            self.snapshots.pop(0)
            self.history[len(self.history) - len(self.snapshots) - 1].undoable = False
        self.df = df

    def undo(self, steps: int = 1) -> None:
        if not 1 <= steps <= len(self.snapshots):
            raise expressions.ExpressionError("INVALID_OPERATION", f"{len(self.snapshots)} steps can be undone")
        for _ in range(steps):
            self.df = self.snapshots.pop()
            self.history.pop()


def _where(df: DataFrame, where: str, check: bool = True) -> DataFrame:
    return clean.drop_rows(df, expressions.condition(df, where), check)


#: Operations by name; parameters are those of the functions.
OPERATIONS: dict[str, Callable] = {
    "fill_missing": clean.fill_missing, "flag_missing": clean.flag_missing, "drop_missing": clean.drop_missing, "drop_duplicates": clean.drop_duplicates, "drop_columns": clean.drop_columns,
    "drop_rows": _where, "remove_outliers": clean.remove_outliers, "replace_values": clean.replace_values, "merge_variants": clean.merge_variants, "rename_columns": clean.rename_columns,
    "cast_type": clean.cast_type, "strip_whitespace": clean.strip_whitespace, "standardize_case": clean.standardize_case, "parse_dates": clean.parse_dates,
}


TOOLS = ("load_dataset", "profile", "find_issues", "analyze_column", "check_relationships", "analyze_target", "query", "connect_database", "explore_schema", "clean_data", "history", "manage_sources")
REFUSALS = {clean.Refused: "OPERATION_REFUSED"}


class Session:
    def __init__(self, spark: SparkSession, roots: tuple[str, ...] = ()):
        self.spark, self.roots = spark, roots
        self.datasets: dict[str, Dataset] = {}
        self.connections: dict[str, tables.SqliteConnection] = {}

    def call(self, tool: str, *args, seconds: float | None = None, **how) -> dict:
        """A tool by name: its response, or the error as a response.  Jobs that run beyond ``seconds`` are cancelled."""
        if tool not in TOOLS:
            return response.error("INVALID_OPERATION", f"no tool {tool}")
        context, tag, late = self.spark.sparkContext, f"lumenscan-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        clock = threading.Timer(seconds, stop) if seconds else None
        context.addJobTag(tag)
        try:
            if clock:
                clock.start()
            return getattr(self, tool)(*args, **how)
        except Exception as e:  # a response tells every failure; unforeseen ones by an id alone, as their text may hold data
            if late.is_set():
                return response.error("QUERY_TIMEOUT", f"{tool} took over {seconds:g} seconds", "ask for less or allow more time")
            if isinstance(e, (ValueError, TypeError)) and not isinstance(e, PySparkException):
                return response.error(getattr(e, "code", REFUSALS.get(type(e), "INVALID_OPERATION")), str(e))
            return response.error("INTERNAL_ERROR", f"{type(e).__name__}, reference {uuid.uuid4().hex[:8]}")
        finally:
            if clock:
                clock.cancel()
            context.removeJobTag(tag)

    def _alias(self, wanted: str) -> str:
        base = re.sub(r"\W+", "_", wanted.lower()).strip("_") or "data"
        name, i = base, 2
        while name in self.datasets or name in self.connections:
            name, i = f"{base}_{i}", i + 1
        return name

    def get(self, alias: str) -> Dataset:
        if alias not in self.datasets:
            raise expressions.ExpressionError("SOURCE_NOT_FOUND", f"no dataset {alias}")
        return self.datasets[alias]

    def register(self, df: DataFrame, alias: str, origin: str = "frame") -> Dataset:
        data = Dataset(self._alias(alias), df, origin)
        self.datasets[data.alias] = data
        return data

    def load_dataset(self, source: str, alias: str | None = None, limit: int | None = None, options: dict | None = None) -> dict:
        connection, _, table = source.partition(".")
        if connection in self.connections and table:
            df = self.connections[connection].table(self.spark, table.split(".")[-1], limit)
            data = self.register(df, alias or table, source)
            return response.envelope("load_dataset", {"alias": data.alias, "columns": df.columns})
        df, report = files.load(self.spark, source, roots=self.roots, limit=limit, options=options)
        data = self.register(df, alias or source.rsplit("/", 1)[-1].rsplit(".", 1)[0], source)
        return response.envelope("load_dataset", {"alias": data.alias, "format": report.format, "encoding": report.encoding, "delimiter": report.delimiter, "coerced": report.coerced, "notes": report.notes, "rows": df.count(), "kinds": profile.column_kinds(df)})

    def profile(self, alias: str, columns: list[str] | None = None) -> dict:
        df = self.get(alias).df
        self._known(df, columns or [])
        df = df.select(*[f"`{c}`" for c in columns]) if columns else df
        kinds = profile.column_kinds(df)
        numbers = [c for c, k in kinds.items() if k == "numeric"]
        texts = [c for c, k in kinds.items() if k in ("text", "categorical")]
        stats = {r["column"]: r.asDict() for r in profile.numeric_profile(df, numbers).collect()} if numbers else {}
        for r in profile.top_values(df, texts).orderBy("column", "rank").collect() if texts else []:
            stats.setdefault(r["column"], {}).setdefault("top", []).append([r["value"], r["n"]])
        body = [{"column": c, "kind": k, **{a: b for a, b in stats.get(c, {}).items() if a != "column"}} for c, k in kinds.items()]
        shown, left = response.fit([response.compact(response.to_json(x)) for x in body], int(0.6 * response.BUDGETS["profile"]))
        return response.envelope("profile", {"columns": shown, "columns_left_out": left or None}, [vars(f) for f in issues.find_issues(df)])

    def find_issues(self, alias: str, severity: str = "all") -> dict:
        if severity not in ("all", issues.LOW, issues.MEDIUM, issues.HIGH):
            raise expressions.ExpressionError("INVALID_OPERATION", "severity is all, low, medium or high")
        found = issues.find_issues(self.get(alias).df)
        counts = {s: sum(f.severity == s for f in found) for s in issues.RANK}
        return response.envelope("find_issues", {"counts": counts, "needs_attention": bool(counts[issues.HIGH] + counts[issues.MEDIUM])}, [vars(f) for f in found if severity in ("all", f.severity)])

    def analyze_column(self, alias: str, column: str) -> dict:
        df = self.get(alias).df
        self._known(df, [column])
        kind = profile.column_kinds(df.select(f"`{column}`"))[column]
        parts = {"numeric": (profile.numeric_profile, profile.percentiles, profile.mode_value, profile.z_outliers, profile.modified_z_outliers, profile.transform_skews), "datetime": (profile.datetime_gaps,)}.get(kind, (profile.text_checks,) if kind != "boolean" else ())
        body: dict = {"column": column, "kind": kind}
        for f in parts:
            r = f(df, [column]).first()
            body |= {k: v for k, v in (r.asDict() if r else {}).items() if k != "column"}
        if kind == "numeric":
            moments = df.select(F.col(f"`{column}`").cast("double").alias("v")).agg(F.count("v").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2")).first()
            if moments["g1"] is not None and math.isfinite(moments["g1"]):
                body["normality_p"] = special.normality_p(moments["n"], moments["g1"], moments["g2"] + 3)
            body["histogram"] = [r["n"] for r in profile.histogram(df, [column]).orderBy("bin").collect()]
        elif kind == "datetime":
            body["calendar"] = [[r["unit"], r["value"], r["n"]] for r in profile.calendar_breakdown(df, [column]).orderBy("unit", "value").collect()]
        else:
            body["top"] = [[r["value"], r["n"]] for r in profile.top_values(df, [column], 10).orderBy("rank").collect()]
        if kind == "identifier":
            body["shapes"] = [[r["shape"], r["n"]] for r in profile.key_shapes(df, [column]).orderBy("rank").collect()]
        if kind == "categorical":
            body["encoding"] = issues.encoding_advice(body["n_unique"], body["median_length"])
        return response.envelope("analyze_column", body)

    def check_relationships(self, alias: str, target: str | None = None, group_by: str | None = None) -> dict:
        df = self.get(alias).df
        self._known(df, [c for c in (target, group_by) if c])
        kinds = profile.column_kinds(df)
        numbers = [c for c, k in kinds.items() if k in ("numeric", "datetime")]
        if group_by:
            groups = {r["column"]: r["n_unique"] for r in profile.kinds(df.select(f"`{group_by}`")).collect()}[group_by]
            if groups > MOST_GROUPS:
                raise expressions.ExpressionError("INVALID_OPERATION", f"{groups} groups are too many to compare")
            by: dict[str, list] = {}
            compared = [c for c in numbers if c != group_by]
            for r in relations.group_statistics(df, compared, group_by).collect() if compared else []:
                by.setdefault(r["column"], []).append(r)
            found = [{"column": c, **x} for c, x in ((c, relations.compare_groups(rows)) for c, rows in by.items()) if x and x["eta2"] >= LEAST_EFFECT and x["p"] < LEAST_EFFECT]
            for c in (c for c, k in kinds.items() if k in ("categorical", "boolean") and c != group_by):
                v = relations.cramers_v(df, c, group_by).first()["v"]
                found += [{"column": c, "v": v, "eta2": v * v}] if v is not None and v * v >= LEAST_EFFECT else []
            return response.envelope("check_relationships", {"group_by": group_by, "differences": sorted(found, key=lambda x: (-x["eta2"], x["column"]))})
        pairs = [(r["a"], r["b"], r["r"]) for r in relations.pearson_pairs(df, numbers).collect()] if len(numbers) > 1 else []
        ranks = {(r["a"], r["b"]): r["r"] for r in relations.spearman_pairs(df, numbers).collect()} if len(numbers) > 1 else {}
        categories = [c for c, k in kinds.items() if k in ("categorical", "boolean")]
        found = []
        for a, b, r in pairs:
            rho = ranks.get((a, b))
            s = max(abs(r or 0), abs(rho or 0))
            found.append({"a": a, "b": b, "strength": s, "how": "monotone, not linear" if rho is not None and abs(rho) - abs(r or 0) >= 0.1 else "linear"})
        for i, a in enumerate(categories):
            for b in categories[i + 1 :]:
                v = relations.cramers_v(df, a, b).first()["v"]
                found += [{"a": a, "b": b, "strength": v, "how": "association"}] if v is not None else []
            by = {}
            for r in relations.group_statistics(df, numbers, a).collect() if numbers else []:
                by.setdefault(r["column"], []).append(r)
            for b, rows in by.items():
                x = relations.compare_groups(rows)
                found += [{"a": a, "b": b, "strength": x["eta2"] ** 0.5, "how": "group differences"}] if x and x["p"] < LEAST_EFFECT else []
        least = 0.1 if target else relations.STRONG
        found = sorted((x for x in found if x["strength"] >= least and (not target or target in (x["a"], x["b"]))), key=lambda x: (-x["strength"], x["a"], x["b"]))
        vif = {c: v for c, v in relations.variance_inflation(numbers, pairs).items() if v > relations.VIF_LIMIT} if pairs else {}
        shown, left = response.fit(found, 500)
        clusters = relations.collinear_clusters(pairs)
        present = {r["column"]: -r["missing"] for r in profile.missing_summary(df).collect()} if clusters else {}
        advice = [vars(f) for f in issues.collinear_advice(clusters, present, df.columns)]
        return response.envelope("check_relationships", {"pairs": shown, "pairs_left_out": left or None, "clusters": clusters, "inflated": vif}, advice)

    def analyze_target(self, alias: str, target: str) -> dict:
        df = self.get(alias).df
        self._known(df, [target])
        try:
            found = issues.analyze_target(df, target)
        except ValueError as e:
            raise expressions.ExpressionError("INVALID_OPERATION", str(e)) from None
        return response.envelope("analyze_target", {"task": found["task"], "health": found["health"], "strengths": found["strengths"][:10]}, [vars(f) for f in found["findings"]])

    def query(self, source: str, text: str, limit: int = 20) -> dict:
        if source in self.connections:
            found = self.connections[source].query(self.spark, text, limit + 1)
            rows = [list(r) for r in found.collect()]
            return response.envelope("query", {"rows": rows[:limit], "more_rows": len(rows) > limit})
        df = self.get(source).df
        rows = [r.asDict() for r in expressions.evaluate(df, text, limit).collect()]
        return response.envelope("query", {"rows": rows} | self._whole(df, text))

    @staticmethod
    def _whole(df: DataFrame, text: str) -> dict:
        """What the first rows do not tell: how many rows meet a condition, or the summary of a computed column."""
        found = expressions.Compiler(df.schema).compile(text)
        if not isinstance(found, expressions.Value) or found.scalar:
            return {}
        if found.family == "bool":
            return expressions.count_matching(df, text).first().asDict()
        return {"summary": expressions.summary(df, text).first().asDict()}

    def sql(self, text: str, limit: int | None = None) -> DataFrame:
        return guard.run(self.spark, text, {k: d.df for k, d in self.datasets.items()}, limit)

    def clean_data(self, alias: str, operations: list[dict]) -> dict:
        """All operations are checked first; a refused one is skipped, an error undoes the batch."""
        data = self.get(alias)
        for i, o in enumerate(operations):
            f = OPERATIONS.get(o.get("op", ""))
            if f is None:
                raise expressions.ExpressionError("INVALID_OPERATION", f"step {i + 1}: no operation {o.get('op')}")
            known = inspect.signature(f).parameters
            takes_any = any(p.kind is p.VAR_KEYWORD for p in known.values())
            for k in o:
                if k != "op" and k not in known and not takes_any:
                    raise expressions.ExpressionError("INVALID_OPERATION", f"step {i + 1}: {o['op']} has no parameter {k}")
            if o.get("column") is not None:
                self._known(data.df, [o["column"]], i)
        df, done = data.df, []
        for o in operations:
            how = {k: v for k, v in o.items() if k != "op"}
            try:
                df = OPERATIONS[o["op"]](df, **how)
                done.append({"op": o["op"], "done": True})
            except clean.Refused as e:
                done.append({"op": o["op"], "done": False, "why": str(e)})
        if any(x["done"] for x in done):
            before, after = data.df.count(), df.count()
            data.commit(df, Operation(", ".join(x["op"] for x in done if x["done"]), before, after))
        return response.envelope("clean_data", {"alias": alias, "operations": done, "rows": data.df.count()})

    def history(self, alias: str, action: str = "list", steps: int = 1) -> dict:
        data = self.get(alias)
        if action == "undo":
            data.undo(steps)
        elif action != "list":
            raise expressions.ExpressionError("INVALID_OPERATION", "the action is list or undo")
        return response.envelope("history", {"alias": alias, "history": [vars(o) for o in data.history]})

    def connect_database(self, alias: str, path: str) -> dict:
        self.connections[self._alias(alias)] = tables.SqliteConnection(str(files.resolve(path, self.roots)))
        return response.envelope("connect_database", {"alias": alias})

    def explore_schema(self, connection: str, table: str | None = None) -> dict:
        if connection not in self.connections:
            raise expressions.ExpressionError("SOURCE_NOT_FOUND", f"no connection {connection}")
        c = self.connections[connection]
        return response.envelope("explore_schema", c.describe(table) if table else {"tables": c.tables()})

    def manage_sources(self, action: str = "list", alias: str | None = None) -> dict:
        if action == "close":
            if alias not in self.datasets and alias not in self.connections:
                raise expressions.ExpressionError("SOURCE_NOT_FOUND", f"no source {alias}")
            self.datasets.pop(alias, None)
            self.connections.pop(alias, None)
        elif action != "list":
            raise expressions.ExpressionError("INVALID_OPERATION", "the action is list or close")
        return response.envelope("history", {"datasets": [{"alias": d.alias, "origin": d.origin, "steps": len(d.history)} for d in self.datasets.values()], "connections": list(self.connections)})

    def _known(self, df: DataFrame, columns: list[str], step: int | None = None) -> None:
        for c in columns:
            if c not in df.columns:
                raise expressions.ExpressionError("COLUMN_NOT_FOUND", (f"step {step + 1}: " if step is not None else "") + f"no column {c}")
