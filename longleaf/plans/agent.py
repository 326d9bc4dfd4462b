"""Question answering in stages, each a DataFrame: plan, retrieve, compress, answer.

A model's reply is used where it is valid; else each stage has a rule of its own.  Replies are kept (see ``provider.Replies``), so
each prompt is sent once and all that a stage does rests on the same replies.  Questions that
call for a calculation take two calls: the first one writes formulas, which are evaluated here (no code of a
model is executed), the second one answers with their results.
"""

from __future__ import annotations

import ast
import math
import operator
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.operators import bm25, retrieve
from longleaf.plans import provider
from longleaf.session import ship, written

#: How long texts of the rules' answers are, what joins evidence, and what marks a target without evidence.
QUERY_CHARS, KEYWORD_CHARS, EVIDENCE_CHARS = 60, 80, 500
GLUE, NEGATIVE = "\n---\n", "NEGATIVE_VERIFIED"
PLAN = "struct<doc_analysis:array<struct<doc_id:string,relevance:string,reason:string>>,retrieval_plan:array<struct<round:int,description:string,semantic_query:string,keywords:string,answer_type:string,doc_id:string,doc_ids:array<string>>>,needs_second_round:boolean,second_round_reason:string>"


def answer_kind(kind: Column, stated: Column | None = None) -> Column:
    """Format of the answer: as stated, or by the question's type."""
    guess = F.when(kind == "单选题", "mcq").when(kind == "判断题", "tf").when(kind == "多选题", "multi").otherwise("free")
    return guess if stated is None else F.coalesce(F.nullif(stated, F.lit("")), guess)


def route(kind: Column, stated: Column) -> Column:
    """Which of the prompts a question gets, by its type and format: calc, mcq, multi or tf."""
    return F.when(F.coalesce(kind.contains("计算"), F.lit(False)), "calc").when(stated.isin("multi", "tf"), stated).otherwise("mcq")


#: What each stage asks for, by route.
TASKS = {
    "plan": {
        "calc": "Plan what to look up for this calculation: formulas, rates, limits and every parameter.",
        "mcq": "Plan what to look up to find the one right option.",
        "multi": "Plan what to look up for each option, each being a statement of its own.",
        "tf": "Plan what to look up to prove or refute each part of the statement.",
    },
    "answer": {
        "calc": "Take the parameters from the question and the formula from the evidence, work it out step by step and choose the matching option.",
        "mcq": "Weigh each option and choose the only right one.",
        "multi": "Judge each option on its own and choose all that are right.",
        "tf": "Check each part of the statement: A if all of them hold, B if any fails.",
    },
    "formula": {
        "calc": 'Write every step as assignments of arithmetic, the last one to result or results, as JSON {"need_calc": true, "code": "..."}.',
        "mcq": 'If an option compares numbers, write assignments of arithmetic, the last one to results by option, as JSON {"need_calc": true, "code": "..."}; else {"need_calc": false, "code": ""}.',
    },
}


#: What the prompts of the three stages begin with.
PLAN_TASK = "List, as JSON, what has to be looked up to answer this question, and in which documents."
KEEP_TASK = "Keep, in the words of the text, only what bears on:"
ANSWER_TASK = "Answer from the evidence alone, as JSON with correct_options and the clauses you rely on."


def task(stage: str, way: Column) -> Column:
    """The text of a stage for a route (the one of mcq where a route has none)."""
    texts = TASKS[stage]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), way), F.lit(texts["mcq"]))


def fallback_plan(questions: DataFrame) -> DataFrame:
    """One target for each question (qid, question, doc_ids): its beginning as query, its terms as keywords."""
    keywords = F.substring(F.array_join(T.terms(F.col("question")), " "), 1, KEYWORD_CHARS)
    return questions.select("qid", F.lit(0).alias("target_ord"), F.lit(1).alias("round"), F.lit("").alias("description"), F.substring("question", 1, QUERY_CHARS).alias("semantic_query"), keywords.alias("keywords"), F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"))


def parse_plan(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """replies with plan (null if invalid): a list of targets, each with a query and documents."""
    value = T.json_value(F.col(reply_col))
    plan = F.from_json(F.to_json(value), PLAN)
    item = lambda x: (F.coalesce(x["semantic_query"], F.lit("")) != "") & (x["doc_id"].isNotNull() | x["doc_ids"].isNotNull())
    good = F.coalesce((F.size(plan["retrieval_plan"]) > 0) & F.forall(plan["retrieval_plan"], item), F.lit(False))
    return replies.withColumn("plan", F.when(good, plan))


def flatten_plan(plans: DataFrame) -> DataFrame:
    """One row for each target of a plan, in list order; documents as a list or as text with commas."""
    t = plans.where(F.col("plan").isNotNull()).select("qid", F.posexplode("plan.retrieval_plan").alias("target_ord", "t"))
    listed = F.filter(F.transform(F.split(F.coalesce("t.doc_id", F.lit("")), ","), T.strip), lambda x: x != "")
    docs = F.when(F.coalesce(F.size("t.doc_ids"), F.lit(-1)) > 0, F.col("t.doc_ids")).otherwise(listed)
    text = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(""))
    return t.select("qid", "target_ord", F.coalesce("t.round", F.lit(1)).alias("round"), text("description").alias("description"), text("semantic_query").alias("semantic_query"), text("keywords").alias("keywords"), docs.alias("doc_ids"))


def plan(questions: DataFrame, make: Callable[[], provider.Chat] = provider.NoModel, replies: provider.Replies | None = None) -> DataFrame:
    """Targets of questions (qid, question, options, type, doc_ids), by a model or else by rule, with the tokens of the plan's call at its first target."""
    way = route(F.col("type"), answer_kind(F.col("type"), _stated(questions)))
    titles = F.col("titles") if "titles" in questions.columns else F.col("doc_ids")
    asked = questions.select("qid", plan_prompt(way, F.col("question"), F.col("options"), titles).alias("prompt"))
    replies = parse_plan(provider.with_chat(asked, "prompt", make, replies, "plan"))
    planned = flatten_plan(replies)
    rest = questions.join(planned.select("qid").distinct(), "qid", "left_anti")
    spent = replies.select("qid", F.col("prompt_tokens").alias("plan_prompt"), F.col("completion_tokens").alias("plan_completion"))
    first = F.row_number().over(Window.partitionBy("qid").orderBy("target_ord")) == 1
    both = planned.unionByName(fallback_plan(rest)).join(spent, "qid", "left")
    return both.withColumn("is_first", first).withColumns({c: F.when(F.col("is_first"), F.col(c)).otherwise(F.lit(0)) for c in ("plan_prompt", "plan_completion")}).drop("is_first")


def _stated(questions: DataFrame) -> Column:
    return F.col("answer_format") if "answer_format" in questions.columns else F.lit(None).cast("string")


def _options(options: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def plan_prompt(way: Column, question: Column, options: Column, titles: Column) -> Column:
    return F.concat_ws("\n", F.lit(PLAN_TASK), task("plan", way), question, F.coalesce(_options(options), F.lit("")), F.concat(F.lit("Documents: "), F.array_join(F.coalesce(titles, F.array().cast("array<string>")), ", ")))


def compress_prompt(description: Column, evidence: Column) -> Column:
    return F.concat_ws("\n", F.lit(KEEP_TASK), description, F.lit("Text:"), evidence)


def answer_prompt(way: Column, question: Column, options: Column, evidence: Column, calculated: Column | None = None) -> Column:
    parts = [F.lit(ANSWER_TASK), task("answer", way), question, F.coalesce(_options(options), F.lit("")), F.lit("Evidence:"), F.when(evidence == "", F.lit("(nothing found)")).otherwise(evidence)]
    return F.concat_ws("\n", *parts, *([F.lit("Calculated:"), calculated] if calculated is not None else []))


def formula_prompt(way: Column, question: Column, options: Column, evidence: Column) -> Column:
    return F.concat_ws("\n", answer_prompt(way, question, options, evidence), task("formula", way))


def grouped(hits: DataFrame) -> DataFrame:
    """Evidence of each (qid, description, semantic_query): chunk ids and texts in order, in one row."""
    g = hits.groupBy("qid", "description", "semantic_query").agg(F.min("target_ord").alias("target_ord"), F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct("target_ord", "hit", "chunk_id", "text")))).alias("h"))
    return g.select("qid", "target_ord", "description", "semantic_query", F.transform("h", lambda x: x["chunk_id"]).alias("chunk_ids"), F.array_join(F.transform("h", lambda x: x["text"]), GLUE).alias("evidence"))


def compress(hits: DataFrame, make: Callable[[], provider.Chat] = provider.NoModel, replies: provider.Replies | None = None) -> DataFrame:
    """Grouped evidence with compressed_text; a group without evidence is marked, whatever the number of groups, and not sent to the model."""
    prompt = F.when(F.col("evidence") != "", compress_prompt(F.col("description"), F.col("evidence")))
    g = provider.with_chat(grouped(hits).withColumn("prompt", prompt), "prompt", make, replies, "compress").drop("prompt")
    text = F.when(F.col("evidence") == "", F.lit(NEGATIVE)).otherwise(F.coalesce(F.nullif("reply", F.lit("")), F.substring("evidence", 1, EVIDENCE_CHARS)))
    return g.withColumn("compressed_text", text).drop("reply")


def evidence_of(compressed: DataFrame) -> DataFrame:
    """(qid, evidence): texts with their chunk ids under their descriptions, both in the order of the plan."""
    line = F.when(F.col("compressed_text") != "", F.concat(F.lit("["), F.array_join("chunk_ids", ", "), F.lit("] "), F.col("compressed_text")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), "\n")
    by_head = compressed.groupBy("qid", "description").agg(F.min("target_ord").alias("target_ord"), joined(F.when(line.isNotNull(), F.struct("target_ord", "semantic_query", line.alias("text")))).alias("said"), F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"))
    whole = F.struct("target_ord", F.concat_ws("\n", F.nullif("description", F.lit("")), F.nullif("said", F.lit(""))).alias("text"))
    return by_head.groupBy("qid").agg(joined(whole).alias("evidence"), F.sum("p").alias("evidence_prompt"), F.sum("c").alias("evidence_completion"))


def offline_choice(options: Column, evidence: Column) -> Column:
    """Letter of the option that shares most terms with the evidence; empty without options."""
    found = T.terms(evidence)
    scored = F.transform(F.map_entries(options), lambda e: F.struct(F.size(F.array_intersect(T.terms(e["value"]), found)).alias("n"), (-F.ascii(e["key"])).alias("k"), e["key"].alias("key")))
    return F.coalesce(F.array_max(scored)["key"], F.lit(""))


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Not: operator.not_}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
#: Characters of formulas, the largest power they may raise to, the steps they may take, and the numbers of a range.
FORMULA_CHARS, POWER, STEPS, RANGE = 10_000, 64, 100_000, 10_000


def _range(*ends: object) -> list[int]:
    numbers = range(*map(int, ends))
    if len(numbers) > RANGE:
        raise ValueError("too long")
    return list(numbers)


def _small(x: object) -> object:
    """x, if it is no list of lists that would take long to go through."""
    todo, n = [x], 0
    while todo:
        y = todo.pop()
        n += 1
        if n > RANGE:
            raise ValueError("too long")
        if isinstance(y, list | dict):
            todo += y.values() if isinstance(y, dict) else y
    return x


_FUNCTIONS = {"abs": abs, "round": round, "min": min, "max": max, "sum": sum, "len": len, "sorted": sorted, "int": int, "float": float, "bool": bool, "list": list, "any": any, "all": all, "range": _range, "enumerate": lambda x: [list(p) for p in enumerate(x)], "zip": lambda *x: [list(p) for p in zip(*x, strict=False)], "print": lambda *x: None}
_MATH = {n: getattr(math, n) for n in ("ceil", "floor", "sqrt", "log", "log10", "log2", "exp", "fabs", "trunc", "isclose")} | {"pow": lambda a, b: a**b if abs(b) <= POWER else math.nan}


class _Formula:
    """Values of assignments, loops and branches over numbers, comparisons, lists and the functions above, in so many steps; anything else is a ValueError."""

    def __init__(self) -> None:
        self.names: dict[str, object] = {}
        self.left = STEPS

    def step(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise ValueError("too long")

    def put(self, target: ast.expr, x: object) -> None:
        match target:
            case ast.Name(id=name):
                self.names[name] = x
            case ast.Tuple(elts=ts) | ast.List(elts=ts) if isinstance(x, list) and len(x) == len(ts):
                for t, y in zip(ts, x, strict=True):
                    self.put(t, y)
            case ast.Subscript(value=ast.Name(id=name), slice=i) if isinstance(held := self.names.get(name), dict):
                held[str(_small(self.value(i)))] = x
            case _:
                raise ValueError(f"not allowed: {type(target).__name__}")

    def run(self, body: list[ast.stmt]) -> None:
        for line in body:
            self.step()
            match line:
                case ast.Assign(targets=ts, value=v):
                    x = self.value(v)
                    for t in ts:
                        self.put(t, x)
                case ast.AnnAssign(target=t, value=v) if v is not None:
                    self.put(t, self.value(v))
                case ast.AugAssign(target=ast.Name() as t, op=op, value=v):
                    self.put(t, self.value(ast.BinOp(left=ast.Name(id=t.id), op=op, right=v)))
                case ast.If(test=t, body=a, orelse=b):
                    self.run(a if self.value(t) else b)
                case ast.For(target=t, iter=i, body=a, orelse=[]):
                    for x in self.items(i):
                        self.put(t, x)
                        self.run(a)
                case ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Name(id=name), attr="append"), args=[x], keywords=[])) if isinstance(held := self.names.get(name), list):
                    held.append(self.value(x))
                case ast.Expr(value=v):
                    self.value(v)
                case ast.Import(names=[ast.alias(name="math", asname=None)]) | ast.Pass():
                    pass
                case _:
                    raise ValueError(f"not an assignment: {type(line).__name__}")

    def items(self, n: ast.expr) -> list:
        x = self.value(n)
        if not isinstance(x, list | dict):
            raise ValueError("not a list")
        return list(x)

    def comprehended(self, made: ast.expr, loops: list[ast.comprehension]) -> list:
        if not loops:
            return [self.value(made)]
        first, out = loops[0], []
        for x in self.items(first.iter):
            self.put(first.target, x)
            if all(self.value(t) for t in first.ifs):
                out += self.comprehended(made, loops[1:])
        return out

    def number(self, n: ast.AST) -> float:
        x = self.value(n)
        if not isinstance(x, int | float):
            raise ValueError("not a number")
        return float(x)

    def value(self, n: ast.AST) -> object:
        self.step()
        match n:
            case ast.Constant(value=bool() | int() | float() | str() as x):
                return x
            case ast.Name(id=name) if name in self.names:
                return self.names[name]
            case ast.UnaryOp(op=op, operand=x) if type(op) in _UNARY:
                return _UNARY[type(op)](self.value(x) if isinstance(op, ast.Not) else self.number(x))
            case ast.BinOp(left=a, op=ast.Pow(), right=b) if abs(p := self.number(b)) <= POWER:
                return self.number(a) ** p
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](self.number(a), self.number(b))
            case ast.BoolOp(op=op, values=xs):
                return (all if isinstance(op, ast.And) else any)(bool(self.value(x)) for x in xs)
            case ast.Compare(left=a, ops=ops, comparators=xs) if all(type(o) in _COMPARE for o in ops):
                chain = [_small(self.value(x)) for x in (a, *xs)]
                return all(_COMPARE[type(o)](x, y) for o, x, y in zip(ops, chain[:-1], chain[1:], strict=True))
            case ast.IfExp(test=t, body=a, orelse=b):
                return self.value(a if self.value(t) else b)
            case ast.List(elts=xs) | ast.Tuple(elts=xs):
                return [self.value(x) for x in xs]
            case ast.Dict(keys=ks, values=xs) if all(ks):
                return {str(_small(self.value(k))): self.value(x) for k, x in zip(ks, xs, strict=True)}
            case ast.Subscript(value=a, slice=i):
                return self.value(a)[self.value(i)]
            case ast.Call(func=ast.Name(id=name), args=xs, keywords=[]) if name in _FUNCTIONS:
                return _FUNCTIONS[name](*(_small(self.value(x)) for x in xs))
            case ast.Call(func=ast.Attribute(value=ast.Name(id="math"), attr=name), args=xs, keywords=[]) if name in _MATH:
                return _MATH[name](*map(self.number, xs))
            case ast.Attribute(value=ast.Name(id="math"), attr="pi" | "e" as name):
                return getattr(math, name)
            case ast.Call(func=ast.Attribute(value=x, attr="items" | "values" | "keys" as name), args=[], keywords=[]) if isinstance(held := self.value(x), dict):
                return [list(p) if name == "items" else p for p in getattr(held, name)()]
            case ast.ListComp(elt=made, generators=loops) | ast.GeneratorExp(elt=made, generators=loops):
                return self.comprehended(made, loops)
            case ast.DictComp(key=k, value=v, generators=loops):
                return {str(_small(a)): b for a, b in self.comprehended(ast.List(elts=[k, v]), loops)}
        raise ValueError(f"not allowed: {type(n).__name__}")


def evaluate(code: str) -> str:
    """The result of formulas as text: what they assign to results or result, or an expression's value; or what failed.  Code from a model is never executed."""
    try:
        if len(code) > FORMULA_CHARS:
            raise ValueError("too long")
        tree, f = ast.parse(code.strip()), _Formula()
        last = tree.body[-1] if tree.body else None
        if isinstance(last, ast.Expr):
            f.run(tree.body[:-1])
            x = f.value(last.value)
            if x is not None or not {"result", "results"} & f.names.keys():
                return f"result = {_small(x)!r}"
        else:
            f.run(tree.body)
        name = next(n for n in ("results", "result") if n in f.names)
        return f"{name} = {_small(f.names[name])!r}"
    except StopIteration:
        return "failed: no result"
    except (ValueError, SyntaxError, ArithmeticError, RecursionError, TypeError, LookupError, MemoryError) as e:
        return f"failed: {e}"


def calculate(expression: str) -> float | None:
    """Value of an expression of numbers, + - * / and parentheses; null for anything else."""
    try:
        tree = ast.parse(expression, mode="eval")
        if any(isinstance(n, ast.Pow | ast.Call | ast.Name | ast.comprehension) for n in ast.walk(tree)):
            return None
        return _Formula().number(tree.body)
    except (ValueError, SyntaxError, ArithmeticError, RecursionError, TypeError, LookupError, MemoryError):
        return None


def with_calculation(df: DataFrame, reply_col: str) -> DataFrame:
    """df with calculated: the result of the formulas in a reply, or that none was asked for."""
    ship(df.sparkSession)
    value = T.json_value(F.col(reply_col))
    wants = F.coalesce(F.try_variant_get(value, "$.need_calc", "boolean"), F.lit(False))
    code = F.when(wants, F.coalesce(F.try_variant_get(value, "$.code", "string"), F.lit(""))).otherwise(F.lit(""))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(calculated=[evaluate(c) if c.strip() else "failed: nothing to calculate" for c in f["calculated"]])

    out = df.withColumn("calculated", code)
    return out.mapInPandas(run, out.schema)


def answers(questions: DataFrame, compressed: DataFrame, make: Callable[[], provider.Chat] = provider.NoModel, replies: provider.Replies | None = None) -> DataFrame:
    """qid, answer, correct_options, needs_calculation, calculated, prompt_tokens, completion_tokens of every question.

    Questions that need a calculation take two calls, whose tokens are summed.
    """
    e = questions.join(evidence_of(compressed), "qid", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    kind = answer_kind(F.col("type"), _stated(questions))
    needs = T.needs_calculation(F.col("type"), kind, F.col("question"), F.col("options"), F.col("evidence"))
    e = e.select("qid", "question", "options", "type", kind.alias("kind"), route(F.col("type"), kind).alias("way"), needs.alias("needs_calculation"), "evidence", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("evidence_prompt", "evidence_completion")])
    texts = [F.col(c) for c in ("way", "question", "options", "evidence")]
    direct = e.where("not needs_calculation").withColumns({"calculated": F.lit(None).cast("string"), "first_prompt": F.lit(0).cast("long"), "first_completion": F.lit(0).cast("long"), "prompt": answer_prompt(*texts)})
    formulas = provider.with_chat(e.where("needs_calculation").withColumn("prompt", formula_prompt(*texts)), "prompt", make, replies, "formula")
    worked = with_calculation(formulas.withColumnsRenamed({"prompt_tokens": "first_prompt", "completion_tokens": "first_completion"}), "reply").drop("reply", "prompt")
    second = worked.withColumn("prompt", answer_prompt(*texts, F.col("calculated")))
    replied = provider.with_chat(direct.unionByName(second), "prompt", make, replies, "answer")
    chosen = F.from_json(F.to_json(T.json_value(F.col("reply"))), "struct<correct_options:array<string>>")["correct_options"]
    picked = F.coalesce(chosen, F.filter(F.array(offline_choice(F.col("options"), F.col("evidence"))), lambda x: x != ""))
    total = lambda c: (F.col(f"{c}_tokens") + F.col(f"first_{c}") + F.col(f"evidence_{c}")).cast("long").alias(f"{c}_tokens")
    return replied.withColumn("correct_options", picked).select("qid", T.format_answer(F.col("correct_options"), F.col("kind")).alias("answer"), "correct_options", "needs_calculation", "calculated", total("prompt"), total("completion"))


class Trace:
    """What the stages of a run gave, a row for each, counted in the pass that writes a stage's result."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        #: What each stage gave.
        self.tables: dict[str, DataFrame] = {}

    def stage(self, name: str, df: DataFrame, **counted: Column) -> DataFrame:
        """df as a written table; its rows, and those for which each of counted holds, are noted with the seconds it took."""
        began, seen = time.monotonic(), Observation()
        figures = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counted.items()]]
        out = self.tables[name] = written(df.observe(seen, *figures), name)
        got = seen.get
        self.rows.append((name, got.pop("rows"), got, time.monotonic() - began))
        return out

    def table(self, replies: provider.Replies) -> DataFrame:
        """(stage, ord, rows, figures, calls, prompt_tokens, completion_tokens, seconds); a stage's calls are those of its run."""
        made = replies.spark.createDataFrame([(n, k, *r) for k, (n, *r) in enumerate(self.rows)], "stage string, ord int, rows long, figures map<string,long>, seconds double")
        own = F.when(F.col("stage") == "formula", "answer").otherwise(F.col("stage"))
        spent = replies.spent().where(F.col("run") == replies.run).groupBy(own.alias("stage")).agg(*[F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens")])
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return made.join(spent, "stage", "left").select("stage", "ord", "rows", "figures", *map(zero, ("calls", "prompt_tokens", "completion_tokens")), "seconds")


def run(questions: DataFrame, index: bm25.Index, make: Callable[[], provider.Chat] = provider.NoModel, replies: provider.Replies | None = None, trace: Trace | None = None) -> DataFrame:
    """Answers of questions (qid, question, options, type, doc_ids) from an index; tokens are those of all calls.

    Each stage is written when it is done.  With replies of an earlier run, only prompts that it didn't send are sent.
    """
    replies, trace = replies or provider.Replies.temporary(questions.sparkSession), trace or Trace()
    planned = plan(questions, make, replies).withColumn("target", F.concat_ws("#", F.col("qid"), F.col("target_ord").cast("string")))
    targets = trace.stage("plan", planned, first_round=F.col("round") == 1)
    hits = targets.drop("plan_prompt", "plan_completion").join(retrieve.retrieve(index, targets).drop("semantic_query"), "target", "left")
    hits = trace.stage("retrieve", hits, empty=F.col("chunk_id").isNull(), second_try=F.col("source") == "semantic")
    evidence = trace.stage("compress", compress(hits, make, replies), empty=F.col("compressed_text") == NEGATIVE)
    spent = targets.groupBy("qid").agg(F.sum("plan_prompt").alias("p"), F.sum("plan_completion").alias("c"))
    out = answers(questions, evidence, make, replies).join(spent, "qid", "left")
    out = out.withColumns({"prompt_tokens": F.col("prompt_tokens") + F.coalesce("p", F.lit(0)), "completion_tokens": F.col("completion_tokens") + F.coalesce("c", F.lit(0))}).drop("p", "c")
    return trace.stage("answer", out, empty=F.col("answer") == "", calculated=F.col("needs_calculation"))
