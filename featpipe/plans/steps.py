"""SQL step graphs: named steps (table / view / execute) with dependencies and variables.

A spec is run in dependency order on one Spark session (PIP1). Views stay lazy, so Catalyst
plans across steps; ``table`` steps are written as parquet into a staging folder under the
shared checkpoint folder, outputs are counted, and then one commit makes the staged folders current
(``plans/published.py``). A failure before the commit removes staged output, drops temp views created by the run
and restores replaced ones; after the commit nothing is computed, and nothing is deleted. That is the closest Spark gets to the
one-transaction run of a single-file database. ``execute`` steps that change external state cannot be undone.

Besides SQL, a step may name a DataFrame operator (``op``) from ``OPERATORS``: the same
stratified split, for example, runs range-split instead of as a single-task window.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from featpipe.plans.published import Published
from featpipe.session import checkpoint_root

STEP_TYPES = ("table", "view", "execute")


class SpecError(ValueError):
    pass


class StepFailed(RuntimeError):
    def __init__(self, step: str, cause: Exception):
        super().__init__(f"step '{step}' failed: {cause}")
        self.step = step
        self.cause = cause


@dataclass
class Step:
    name: str
    type: str
    sql: str | None = None
    depends_on: list[str] = field(default_factory=list)
    op: str | None = None
    args: dict = field(default_factory=dict)


@dataclass
class StepSpec:
    name: str
    steps: list[Step]
    outputs: list[str]
    vars: dict | None = None
    description: str = ""

    @classmethod
    def from_dict(cls, d: dict) -> StepSpec:
        steps = [Step(name=s.get("name", ""), type=s.get("type", ""), sql=s.get("sql"),
                      depends_on=list(s.get("depends_on") or []), op=s.get("op"), args=dict(s.get("args") or {}))
                 for s in d.get("steps") or []]
        return cls(name=d.get("name", ""), steps=steps, outputs=list(d.get("outputs") or []),
                   vars=d.get("vars"), description=d.get("description", ""))

    @classmethod
    def from_yaml(cls, text: str) -> StepSpec:
        try:
            import yaml  # optional
        except ImportError as e:  # pragma: no cover
            raise SpecError("PyYAML is not installed; build the spec with from_dict") from e
        return cls.from_dict(yaml.safe_load(text))

    def to_dict(self) -> dict:
        steps = []
        for s in self.steps:
            d = {"name": s.name, "type": s.type, "depends_on": list(s.depends_on)}
            if s.op:
                d.update({"op": s.op, "args": dict(s.args)})
            else:
                d["sql"] = s.sql
            steps.append(d)
        out = {"name": self.name, "description": self.description, "steps": steps, "outputs": list(self.outputs)}
        if self.vars:
            out["vars"] = dict(self.vars)
        return out

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=False)


# ---------------------------------------------------------------- spec checks (PIP5, PIP2, PIP3)

def validate(spec: StepSpec) -> None:
    if not spec.steps:
        raise SpecError("spec has no steps")
    seen = set()
    for s in spec.steps:
        if not s.name or not s.name.strip():
            raise SpecError("every step needs a name")
        if s.name in seen:
            raise SpecError(f"duplicate step name '{s.name}'")
        seen.add(s.name)
        if s.type not in STEP_TYPES:
            raise SpecError(f"step '{s.name}': type must be one of {STEP_TYPES}, got '{s.type}'")
        if s.op is None and (not s.sql or not s.sql.strip()):
            raise SpecError(f"step '{s.name}' has no SQL")
        if s.op is not None and s.op not in OPERATORS:
            raise SpecError(f"step '{s.name}': unknown operator '{s.op}'")
        if len(set(s.depends_on)) != len(s.depends_on):
            raise SpecError(f"step '{s.name}' lists a dependency twice")
    if not spec.outputs:
        raise SpecError("spec has no outputs")
    by_name = {s.name: s for s in spec.steps}
    for o in spec.outputs:
        if o not in by_name:
            raise SpecError(f"output '{o}' is not a step")
        if by_name[o].type == "execute":
            raise SpecError(f"output '{o}' is an execute step")


def order_steps(spec: StepSpec) -> list[Step]:
    """Dependency order; ties keep the order of the spec. Unknown names are external tables.

    A cycle is an error that names its path, e.g. ``a -> b -> a``.
    """
    names = [s.name for s in spec.steps]
    pos = {n: i for i, n in enumerate(names)}
    deps = {s.name: [d for d in s.depends_on if d in pos] for s in spec.steps}
    cycle = _find_cycle(names, deps)
    if cycle:
        raise SpecError("dependency cycle: " + " -> ".join(cycle))
    indeg = {n: len(deps[n]) for n in names}
    users: dict[str, list[str]] = {n: [] for n in names}
    for n in names:
        for d in deps[n]:
            users[d].append(n)
    ready = sorted([n for n in names if indeg[n] == 0], key=pos.get)
    out = []
    while ready:
        n = ready.pop(0)
        out.append(n)
        for u in users[n]:
            indeg[u] -= 1
            if indeg[u] == 0:
                ready.append(u)
                ready.sort(key=pos.get)
    by_name = {s.name: s for s in spec.steps}
    return [by_name[n] for n in out]


def _find_cycle(names, deps) -> list[str] | None:
    state: dict[str, int] = {}
    stack: list[str] = []

    def visit(n):
        state[n] = 1
        stack.append(n)
        for d in deps[n]:
            if state.get(d) == 1:
                i = stack.index(d)
                return stack[i:] + [d]
            if state.get(d) is None:
                r = visit(d)
                if r:
                    return r
        stack.pop()
        state[n] = 2
        return None

    for n in names:
        if state.get(n) is None:
            r = visit(n)
            if r:
                return list(reversed(r))
    return None


# ---------------------------------------------------------------- SQL text (PIP4, PIP10)

_VAR = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def substitute(sql: str, variables: dict | None) -> str:
    """Replace ``${name}``; an undefined name is an error (also when no vars are given)."""
    names = _VAR.findall(sql)
    if not names:
        return sql
    variables = variables or {}
    missing = sorted({n for n in names if n not in variables})
    if missing:
        raise SpecError(f"undefined variables: {', '.join(missing)}")
    return _VAR.sub(lambda m: str(variables[m.group(1)]), sql)


def to_spark_sql(sql: str, spark: SparkSession | None = None) -> str:
    """DuckDB forms used by pipelines -> Spark SQL (see ``plans/dialect.py``)."""
    from featpipe.plans.dialect import translate

    return translate(sql, spark)


def syntax_errors(spark: SparkSession, spec: StepSpec) -> dict[str, str]:
    """Parser errors per step (PIP6). Missing tables are not reported: they may be created
    by earlier steps."""
    errs = {}
    for s in spec.steps:
        if s.op is not None:
            continue
        try:
            text = to_spark_sql(substitute(s.sql, spec.vars))
            with _quoted_identifiers(spark):
                spark.sql("EXPLAIN " + text)
        except ParseException as e:
            errs[s.name] = str(e).splitlines()[0]
        except (SpecError, ValueError) as e:
            errs[s.name] = str(e)
        except Exception:  # noqa: BLE001 - analysis errors are expected here
            pass
    return errs


class _quoted_identifiers:
    """``"name"`` is an identifier, as in ANSI SQL and DuckDB, for the duration of a run."""

    KEY = "spark.sql.ansi.doubleQuotedIdentifiers"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get(self.KEY, "false")
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *a):
        self.spark.conf.set(self.KEY, self.old)


# ---------------------------------------------------------------- DataFrame operator steps

def _op_stratified_split(spark, args):
    from featpipe.operators.splits import stratified_split

    return stratified_split(spark.table(args["source"]), args["target"], args["order_by"],
                            int(args.get("train_tenths", 8)), args.get("out", "split"))


def _op_hash_split(spark, args):
    from featpipe.operators.splits import hash_split

    return hash_split(spark.table(args["source"]), args["key"], tuple(args.get("weights", (8, 2))))


OPERATORS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "stratified_split": _op_stratified_split,
    "hash_split": _op_hash_split,
}


# ---------------------------------------------------------------- running

@dataclass
class RunReport:
    ok: bool
    spec: str
    executed: list[str] = field(default_factory=list)
    outputs: dict = field(default_factory=dict)
    log: list[tuple[str, str]] = field(default_factory=list)
    sql_text: str = ""
    error: str | None = None
    failed_step: str | None = None
    seconds: float = 0.0


def _hadoop_fs(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _temp_view_exists(spark, name) -> bool:
    """Direct catalog lookup (listing the whole catalog costs a round trip per table)."""
    if not spark.catalog.tableExists(name):
        return False
    try:
        return bool(spark.catalog.getTable(name).isTemporary)
    except Exception:  # noqa: BLE001
        return False


_DROP = re.compile(r"^\s*DROP\s+(TABLE|VIEW)\s+(IF\s+EXISTS\s+)?\"?([A-Za-z_][A-Za-z0-9_.]*)\"?\s*$", re.IGNORECASE)


class StepRunner:
    """Runs a ``StepSpec`` (PIP1), or only checks it (``dry_run``, PIP7)."""

    def __init__(self, spark: SparkSession, table_root: str | None = None):
        self.spark = spark
        self.table_root = (table_root or f"{checkpoint_root(spark)}/featpipe_tables").rstrip("/")

        self.published = Published(spark, self.table_root)

    def table_path(self, name: str) -> str:
        """Folder that holds the table's published rows (for a table never published: where none are)."""
        return self.published.folder(name) or f"{self.table_root}/{name}"

    def _exists(self, path) -> bool:
        fs, p = _hadoop_fs(self.spark, path)
        return fs.exists(p)

    def run(self, spec: StepSpec, count_outputs: bool = True, dry_run: bool = False, keep_views: bool = False
            ) -> tuple[RunReport, dict]:
        t0 = time.time()
        self._last_replaced = {}
        validate(spec)
        report = RunReport(ok=False, spec=spec.name)
        errs = syntax_errors(self.spark, spec)
        if errs:
            name, msg = next(iter(errs.items()))
            report.error, report.failed_step = f"syntax error in step '{name}': {msg}", name
            report.log.append((report.error, "error"))
            return report, {}
        order = order_steps(spec)
        run_id = uuid.uuid4().hex[:12]
        staging = f"{self.table_root}/_versions/{run_id}"
        replaced: dict[str, DataFrame | None] = {}
        staged: dict[str, str] = {}
        drops: list[str] = []
        frames: dict[str, DataFrame] = {}
        texts = []
        try:
            base = self.published.version()
            with _quoted_identifiers(self.spark):
                for s in order:
                    report.log.append((f"step {s.name} ({s.type})", "info"))
                    try:
                        if s.op is None:
                            text = to_spark_sql(substitute(s.sql, spec.vars), self.spark)
                            texts.append(f"-- {s.name} ({s.type})\n{text};")
                        else:
                            text = None
                            texts.append(f"-- {s.name} ({s.type}): operator {s.op}({s.args})")
                        if s.type == "execute":
                            self._execute(text, dry_run, drops, replaced)
                        else:
                            df = OPERATORS[s.op](self.spark, s.args) if s.op else self.spark.sql(text)
                            if s.type == "table" and not dry_run:
                                path = f"{staging}/{s.name}"
                                staged[s.name] = path
                                df.write.mode("overwrite").parquet(path)
                                df = self.spark.read.parquet(path)
                            self._register(s.name, df, replaced)
                            frames[s.name] = df
                    except Exception as e:  # noqa: BLE001
                        raise StepFailed(s.name, e) from e
                    report.executed.append(s.name)
            self._last_replaced = replaced
            # all that can fail comes before the commit: a view's rows are computed here for the first time
            for o in spec.outputs:
                step = next(s for s in spec.steps if s.name == o)
                info = {"type": step.type, "schema": [(f.name, f.dataType.simpleString()) for f in frames[o].schema.fields]}
                if count_outputs and not dry_run:
                    try:
                        # a table's count is read from its staged files' footers. (An Observation on the write would leave the session
                        # with a member that cannot be serialised, and MLlib models used later in it would fail.)
                        info["rows"] = frames[o].count()
                    except Exception as e:  # noqa: BLE001
                        raise StepFailed(o, e) from e
                report.outputs[o] = info
            if dry_run:
                if not keep_views:
                    self._rollback(replaced, staged, staging)
            else:
                self._publish(staged, drops, base)  # the staged folders become the tables: frames and views read them already
            report.ok = True
        except Exception as e:  # noqa: BLE001 - a failed step, count or commit: nothing was published
            self._rollback(replaced, staged, staging)
            report.error, report.failed_step = str(e), getattr(e, "step", None)
            report.log.append((report.error, "error"))
            report.outputs, frames = {}, {}
        report.sql_text = "\n\n".join(texts)
        report.seconds = time.time() - t0
        return report, {o: frames[o] for o in spec.outputs if o in frames}

    def dry_run(self, spec: StepSpec, sample: int | None = None) -> tuple[bool, str | None]:
        """Analyse every step without writing anything; returns (ok, error naming the step).

        Analysis finds missing tables, columns and type errors. Errors that only data can
        raise (a failing cast, a division under ANSI mode) need ``sample``: each output then
        computes its first ``sample`` rows (a bounded run, still nothing written).
        """
        if not sample:
            report, _ = self.run(spec, count_outputs=False, dry_run=True)
            return report.ok, report.error
        report, frames = self.run(spec, count_outputs=False, dry_run=True, keep_views=True)
        try:
            if not report.ok:
                return False, report.error
            for name, df in frames.items():
                try:
                    df.limit(int(sample)).collect()
                except Exception as e:  # noqa: BLE001
                    return False, f"step '{name}' failed on sample rows: {e}"
            return True, None
        finally:
            self._rollback(self._last_replaced, {}, "")

    # -- helpers

    def _register(self, name, df, replaced):
        if name not in replaced:
            replaced[name] = self.spark.table(name) if _temp_view_exists(self.spark, name) else None
        df.createOrReplaceTempView(name)

    def _execute(self, text, dry_run, drops, replaced):
        m = _DROP.match(text)
        if m:
            kind, name = m.group(1).upper(), m.group(3)
            is_view = _temp_view_exists(self.spark, name)
            is_table = self._exists(self.table_path(name))
            if kind == "VIEW" and is_table and not is_view:
                raise SpecError(f"DROP VIEW on '{name}', which is a table")
            if kind == "TABLE" and is_view and not is_table:
                raise SpecError(f"DROP TABLE on '{name}', which is a view")
            if is_view:
                if name not in replaced:
                    replaced[name] = self.spark.table(name)
                self.spark.catalog.dropTempView(name)
            if is_table and not dry_run:
                drops.append(name)
            if not (is_view or is_table) and not m.group(2):
                raise SpecError(f"'{name}' does not exist")
            return
        if dry_run:
            return
        self.spark.sql(text)

    def _rollback(self, replaced, staged, staging):
        for name, old in replaced.items():
            try:
                if old is None:
                    self.spark.catalog.dropTempView(name)
                else:
                    old.createOrReplaceTempView(name)
            except Exception:  # noqa: BLE001
                pass
        if staged:
            fs, p = _hadoop_fs(self.spark, staging)
            fs.delete(p, True)

    def _publish(self, staged, drops, base):
        """All tables of the run at once: their folders become current when one pointer file is created. ``base``: the version
        that was current when the run began; a run whose tables were published by another one since then is refused."""
        if staged or drops:
            self.published.publish(dict(staged), [d for d in drops if d not in staged], base)


def run_steps(spark: SparkSession, spec: StepSpec | dict, **kw) -> tuple[RunReport, dict]:
    if isinstance(spec, dict):
        spec = StepSpec.from_dict(spec)
    return StepRunner(spark, kw.pop("table_root", None)).run(spec, **kw)
