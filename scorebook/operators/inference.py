"""Batch inference over (sample x condition) rows.

The model call itself is user code: a *predictor* object with ``load()``, ``unload()``
and ``predict(content: bytes | None, prompt: str) -> dict`` (keys ``raw_output``,
``latency_s``, ``input_tokens``, ``output_tokens``, ``cost_usd``, ``error``; all
optional), or ``predict_batch(contents, prompts)`` giving a list of those, or both.
This module only distributes the calls:

* J1: every sample under every condition, by expanding the condition list as a
  literal array, no join;
* D6: the calls are one stage of ``parallelism`` tasks; as a barrier stage it is not speculated
  either, so no more calls than that are ever open in the cluster, whatever the slots;
* D1/D3: ``mapInPandas`` loads one predictor per task, calls it, unloads it in ``finally``;
* D7: rows of one model are put in batches of ``batch_size`` by length and handed to the
  predictor's ``predict_batch``; one without it, and the rows of a batch that fails, go one by one;
* D4/D5: transient errors are retried with exponential back-off; a failing row, and the rows of
  a model that does not load, keep an empty answer and the error text, so the task never fails;
* a log of answers (:class:`AnswerLog`) in shared storage, by the key of the call: a task that is
  run again, or a run that is started again, reads its own paid answers instead of asking again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTPUT_FIELDS = [
    T.StructField("raw_output", T.StringType()),
    T.StructField("inference_time_s", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("error", T.StringType()),
]


class PredictorRegistry:
    """Backend name -> predictor factory (picklable callables)."""

    def __init__(self) -> None:
        self._factories: dict[str, Callable[[dict], object]] = {}

    def register(self, backend: str, factory: Callable[[dict], object]) -> None:
        self._factories[backend] = factory

    def build(self, settings: dict) -> object:
        backend = settings.get("backend")
        if backend not in self._factories:
            raise ValueError(f"unknown backend {backend!r}; known: {sorted(self._factories)}")
        return self._factories[backend](settings)

    def backends(self) -> list[str]:
        return sorted(self._factories)


def expand_conditions(samples: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every sample under every condition.

    The conditions are the experiment's configuration (models x prompts, built from the
    driver's own settings); they are expanded with ``inline`` from a literal array, so the
    sample table is never joined or shuffled."""
    fields = conditions.schema.fields
    structs = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields])
               for r in conditions.collect()]
    if not structs:
        return samples.limit(0).select(
            "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    return samples.select("*", F.inline(F.array(*structs)))


def with_retries(call: Callable[[], dict], max_retries: int = 3, base_delay_s: float = 2.0,
                 is_transient: Callable[[Exception], bool] = lambda e: True,
                 sleep: Callable[[float], None] = time.sleep) -> dict:
    """Up to ``max_retries`` retries after the first attempt, sleeping
    base, 2 x base, 4 x base ...; fatal errors and exhausted retries end in a result
    with the last error's text instead of an exception (a fatal one also with the time spent)."""
    attempt, began = 0, time.perf_counter()
    while True:
        try:
            return call()
        except Exception as e:  # noqa: BLE001 - any predictor error is data here
            text = f"{type(e).__name__}: {e}"
            if not is_transient(e):
                return {"raw_output": "", "error": text, "latency_s": time.perf_counter() - began}
            if attempt >= max_retries:
                return {"raw_output": "", "error": f"Max retries exceeded: {text}", "latency_s": 0.0}
            sleep(base_delay_s * (2 ** attempt))
            attempt += 1


class AnswerLog:
    """Answers by call key, in a folder of shared storage: Arrow files below one folder per group of
    calls.  A file is written under another name first and then moved, so readers see whole files.

    ``folder``: a path or URI that pyarrow's file systems reach (local and mounted paths, hdfs, s3,
    gcs), from every executor."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _open(self):
        from pyarrow import fs
        if self.folder.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.folder[5:].lstrip("/")
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def read(self, group: str) -> dict[str, dict]:
        from pyarrow import fs, ipc
        system, root = self._open()
        out: dict[str, dict] = {}
        for info in system.get_file_info(fs.FileSelector(f"{root}/{group}", allow_not_found=True)):
            if info.path.endswith(".arrow"):
                with system.open_input_file(info.path) as f:
                    for row in ipc.open_file(f).read_all().to_pylist():
                        out[row.pop("call_key")] = row
        return out

    def add(self, group: str, answers: dict[str, dict]) -> None:
        if not answers:
            return
        from pyarrow import ipc
        system, root = self._open()
        system.create_dir(f"{root}/{group}", recursive=True)
        table = pa.Table.from_pylist([{"call_key": k, **{n: v.get(n) for n in ANSWER_FIELDS}} for k, v in answers.items()],
                                     schema=pa.schema([("call_key", pa.string()), *ANSWER_FIELDS.items()]))
        name = f"{root}/{group}/{uuid.uuid4().hex}"
        with system.open_output_stream(f"{name}.part") as f, ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        system.move(f"{name}.part", f"{name}.arrow")


ANSWER_FIELDS = {"raw_output": pa.string(), "inference_time_s": pa.float64(), "input_tokens": pa.int64(),
                 "output_tokens": pa.int64(), "cost_usd": pa.float64(), "error": pa.string(), "call_rows": pa.int32()}


def _answer(res, seconds: float, call_rows: int) -> dict:
    """One answer's row, from what the predictor gave (a dict, None or an exception)."""
    if isinstance(res, Exception):
        res = {"raw_output": "", "error": f"{type(res).__name__}: {res}"}
    res = res or {}
    latency = res.get("latency_s")
    return {"raw_output": res.get("raw_output", ""),
            "inference_time_s": float(latency if latency is not None else seconds),
            "input_tokens": res.get("input_tokens"), "output_tokens": res.get("output_tokens"),
            "cost_usd": res.get("cost_usd"), "error": res.get("error"), "call_rows": call_rows}


def _ask_one(model, content, prompt, retry) -> dict:
    began = time.perf_counter()
    try:
        if hasattr(model, "predict"):
            res = retry(lambda: model.predict(content, prompt))
        else:
            res = retry(lambda: model.predict_batch([content], [prompt])[0])
    except Exception as e:  # noqa: BLE001 - D5: keep the row
        res = e
    return _answer(res, time.perf_counter() - began, 1)


def _ask(model, contents: Sequence, prompts: Sequence, size: int, retry) -> list[dict]:
    """Answers in the rows' order; batches hold rows of like length."""
    if size <= 1 or not hasattr(model, "predict_batch"):
        return [_ask_one(model, c, p, retry) for c, p in zip(contents, prompts)]
    order = sorted(range(len(prompts)), key=lambda i: len(prompts[i] or "") + len(contents[i] or b""))
    out: list = [None] * len(order)

    def whole(at: list[int]) -> list:
        res = model.predict_batch([contents[i] for i in at], [prompts[i] for i in at])
        if len(res) != len(at):
            raise ValueError(f"predict_batch gave {len(res)} answers for {len(at)} rows")
        return list(res)
    for s in range(0, len(order), size):
        at = order[s:s + size]
        began = time.perf_counter()
        res = retry(lambda at=at: whole(at))
        if isinstance(res, dict):       # the batch as a whole failed: find out which row
            for i in at:
                out[i] = _ask_one(model, contents[i], prompts[i], retry)
        else:
            each = (time.perf_counter() - began) / len(at)
            for i, r in zip(at, res):
                out[i] = _answer(r, each, len(at))
    return out


def _runner(factory: Callable[..., object], content_col: str | None, prompt_col: str,
            model_col: str | None, max_retries: int, base_delay_s: float, is_transient,
            out_cols: Sequence[str], batch_rows: int, batch_size: int = 1,
            group_cols: Sequence[str] = (), key_col: str | None = None, log: AnswerLog | None = None,
            with_calls: bool = False, load_errors: str = "rows"):
    """Per task: at most one predictor loaded at a time.  Rows arrive sorted by group and model,
    so a model is loaded once per group and released before the next."""
    def retry(call):
        return with_retries(call, max_retries, base_delay_s, is_transient)

    def windows(batches):
        """Rows of one (group, model), ``batch_rows`` at a time, across Arrow batches."""
        by = [*group_cols, *([model_col] if model_col else [])]
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            turn = (pdf[by].astype(str) != pdf[by].astype(str).shift()).any(axis=1).to_numpy() if by else [False] * len(pdf)
            starts = [0] + [i for i in range(1, len(pdf)) if turn[i]] + [len(pdf)]
            for a, b in zip(starts, starts[1:]):
                part = pdf.iloc[a:b]
                if held and by and tuple(held[-1][by].astype(str).iloc[-1]) != tuple(part[by].astype(str).iloc[0]):
                    yield pd.concat(held)
                    held = []
                while len(part):
                    room = batch_rows - sum(map(len, held))
                    held.append(part.iloc[:room])
                    part = part.iloc[room:]
                    if sum(map(len, held)) >= batch_rows:
                        yield pd.concat(held)
                        held = []
        if held:
            yield pd.concat(held)

    def run(batches):
        current, model, broken = object(), None, None
        known: dict[str, dict] = {}
        at_group = None
        try:
            for pdf in windows(batches):
                group = "/".join(str(pdf[c].iloc[0]) for c in group_cols) or "all"
                if log is not None and group != at_group:
                    known, at_group = log.read(group), group
                keys = list(pdf[key_col]) if log is not None else [None] * len(pdf)
                todo = [i for i, k in enumerate(keys) if k not in known] if log is not None else list(range(len(pdf)))
                found: list = [known.get(k) for k in keys]
                if todo:
                    name = pdf[model_col].iloc[0] if model_col else None
                    if model is None and broken is None or name != current:
                        if model is not None and hasattr(model, "unload"):
                            model.unload()
                        current, model, broken = name, None, None
                        try:
                            made = factory(name) if model_col else factory()
                            if hasattr(made, "load"):
                                made.load()
                            model = made
                        except Exception as e:  # noqa: BLE001 - a model that does not load is an error of its rows
                            if load_errors == "raise":
                                raise
                            broken = e
                    contents = list(pdf[content_col]) if content_col else [None] * len(pdf)
                    prompts = list(pdf[prompt_col])
                    if broken is not None:
                        answers = [_answer(RuntimeError(f"model did not load: {type(broken).__name__}: {broken}"), 0.0, 0)
                                   for _ in todo]
                    else:
                        answers = _ask(model, [contents[i] for i in todo], [prompts[i] for i in todo], batch_size, retry)
                    for i, a in zip(todo, answers):
                        found[i] = a
                    if log is not None:     # errors are asked again by the next run
                        log.add(group, {keys[i]: a for i, a in zip(todo, answers) if a["error"] is None})
                out = pdf[list(out_cols)].reset_index(drop=True)
                fields = [f.name for f in OUTPUT_FIELDS] + (["call_rows"] if with_calls else [])
                res_df = pd.DataFrame([{n: r[n] for n in fields} for r in found], columns=fields)
                res_df["input_tokens"] = res_df["input_tokens"].astype("Int64")
                res_df["output_tokens"] = res_df["output_tokens"].astype("Int64")
                yield pd.concat([out, res_df], axis=1)
        finally:
            if model is not None and hasattr(model, "unload"):
                model.unload()
    return run


def bucket_of(id_col: str | F.Column, n: int) -> F.Column:
    """0 .. n - 1 from the first 32 bits of md5(id): the same in any engine."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def _expanded(samples: DataFrame, conditions: DataFrame, group_cols: Sequence[str], model_col: str | None,
              one_stage: bool) -> DataFrame:
    """``samples`` under every condition, the rows of a (group, model) one after the other in a task."""
    if model_col is None or model_col not in conditions.columns:
        return expand_conditions(samples.sortWithinPartitions(*group_cols) if group_cols else samples, conditions)
    fields = conditions.schema.fields
    by_model: dict = {}
    for r in conditions.collect():
        by_model.setdefault(r[model_col], []).append(F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]))
    if not by_model:
        return expand_conditions(samples, conditions)
    if one_stage:
        each = F.array(*[F.array(*structs) for structs in by_model.values()])
        per_model = samples.select("*", F.posexplode(each).alias("_model", "_conds")).sortWithinPartitions(*group_cols, "_model")
        return per_model.select(*samples.columns, F.inline("_conds"))
    dealt = samples.sortWithinPartitions(*group_cols) if group_cols else samples
    out = None
    for structs in by_model.values():
        one = dealt.select("*", F.inline(F.array(*structs)))
        out = one if out is None else out.unionByName(one)
    return out


def batch_inference(rows: DataFrame, predictor_factory: Callable[..., object],
                    prompt_col: str = "prompt_text", content_col: str | None = "content",
                    keep_cols: Sequence[str] | None = None, parallelism: int | None = None,
                    model_col: str | None = None,
                    max_retries: int = 3, base_delay_s: float = 2.0,
                    is_transient: Callable[[Exception], bool] = lambda e: True,
                    batch_rows: int = 256, batch_size: int = 1, group_cols: Sequence[str] = (),
                    key_col: str | None = None, log: AnswerLog | None = None, with_calls: bool = False,
                    barrier: bool = False, profile=None, load_errors: str = "rows",
                    conditions: DataFrame | None = None) -> DataFrame:
    """One answer per row.  ``batch_rows`` (D7): answers handed on, and logged, at once.

    ``model_col``: rows name their model; the factory is called with that value and
    rows are sorted by it inside each task (not partitioned by it, so a large model
    never lands in a single task), so a task holds one model at a time.  ``parallelism`` (D6) caps
    the number of concurrent calls; ``barrier`` makes the calls a barrier stage (never speculated;
    of no more tasks than there are slots), ``profile`` gives them executors of their own kind
    (a stage-level resource profile).

    ``batch_size`` (D7): rows given to ``predict_batch`` at once, of one (group, model) each;
    ``with_calls`` adds ``call_rows``, the rows answered by the same call (0: no call).
    ``group_cols``: rows of equal values stay in one task.  With ``log``, answers are kept under
    ``key_col`` below the group's folder and read from there when a task runs again; so the groups
    bound what a task reads.  ``load_errors``: a model that does not load gives its rows an error
    (``rows``) or ends the job (``raise``).

    ``conditions``: ``rows`` are samples, each to be asked under every condition (J1).  They are
    dealt once per sample, by ``group_cols`` of theirs, and expanded after that, so that a content is
    not shuffled or sorted once per condition.  Without ``parallelism`` a task takes one model's
    conditions; with it, so that the calls stay one stage of that many tasks, samples are sorted
    once per model.  Write the result out before analysing it so paid calls are never
    recomputed through lineage."""
    keep = list(keep_cols) if keep_cols is not None else \
        [c for c in rows.columns if c != content_col]
    if log is not None and key_col is None:
        raise ValueError("an answer log needs key_col")
    needed = list(dict.fromkeys([*keep, prompt_col, *([content_col] if content_col else []),
                                 *([model_col] if model_col else []), *group_cols, *([key_col] if key_col else [])]))
    src = rows if conditions is not None else rows.select(*needed)
    if barrier:
        slots = src.sparkSession.sparkContext.defaultParallelism
        parallelism = min(parallelism or slots, slots)
    if group_cols:
        src = src.repartition(*([parallelism] if parallelism else []), *group_cols)
    elif parallelism:
        src = src.repartition(parallelism)      # round-robin: no model lands in one task
    if conditions is not None:
        src = _expanded(src, conditions, group_cols, model_col, one_stage=bool(parallelism)).select(*needed)
    else:
        order = [*group_cols, *([model_col] if model_col else [])]
        if order:
            src = src.sortWithinPartitions(*order)
    schema = T.StructType([src.schema[c] for c in keep] + OUTPUT_FIELDS
                          + ([T.StructField("call_rows", T.IntegerType())] if with_calls else []))
    return src.mapInPandas(_runner(predictor_factory, content_col, prompt_col, model_col,
                                   max_retries, base_delay_s, is_transient, keep, batch_rows, batch_size,
                                   group_cols, key_col, log, with_calls, load_errors), schema, barrier=barrier, profile=profile)


def image_request_payload(content: str, prompt: str, model: str, style: str = "image_url",
                          max_tokens: int = 512, params: dict | None = None) -> F.Column:
    """JSON request body with the image (base64, bytes as stored) and the prompt.

    The media type follows the content's first bytes (PNG, GIF, WebP, else JPEG); ``params``
    are the model's inference parameters, added to the body by name.

    ``image_url``: user message content = [{"type":"image_url","image_url":{"url":
    "data:image/jpeg;base64,..."}}, {"type":"text","text":...}]; ``base64_source``: content =
    [{"type":"image","source":{"type":"base64","media_type":"image/jpeg","data":...}},
    {"type":"text","text":...}].  Null fields are left out of the JSON."""
    # plain (unchunked) base64: Spark may emit MIME-style line breaks every 76 chars
    b64 = F.translate(F.base64(F.col(content)), "\r\n", "")
    head = F.hex(F.substring(F.col(content), 1, 12))
    media = F.when(head.startswith("89504E470D0A1A0A"), F.lit("image/png")) \
        .when(head.startswith("47494638"), F.lit("image/gif")) \
        .when(head.startswith("52494646") & head.endswith("57454250"), F.lit("image/webp")) \
        .otherwise(F.lit("image/jpeg"))
    null_s = F.lit(None).cast("string")
    if style == "image_url":
        url = F.struct(F.concat(F.lit("data:"), media, F.lit(";base64,"), b64).alias("url"))
        image = F.struct(F.lit("image_url").alias("type"), null_s.alias("text"),
                         url.alias("image_url"))
        text = F.struct(F.lit("text").alias("type"), F.col(prompt).alias("text"),
                        F.lit(None).cast("struct<url:string>")
                        .alias("image_url"))
    elif style == "base64_source":
        src_t = "struct<type:string,media_type:string,data:string>"
        image = F.struct(F.lit("image").alias("type"), null_s.alias("text"),
                         F.struct(F.lit("base64").alias("type"), media.alias("media_type"),
                                  b64.alias("data")).alias("source"))
        text = F.struct(F.lit("text").alias("type"), F.col(prompt).alias("text"),
                        F.lit(None).cast(src_t).alias("source"))
    else:
        raise ValueError("style must be 'image_url' or 'base64_source'")
    msg = F.struct(F.lit("user").alias("role"), F.array(image, text).alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"),
                              F.array(msg).alias("messages"),
                              *[F.lit(v).alias(k) for k, v in sorted((params or {}).items())]))


def with_media_token(prompt: F.Column, token: str = "<image>") -> F.Column:
    """P20: prepend ``<image>\\n`` unless the prompt already contains the token."""
    return F.when(F.locate(token, prompt) > 0, prompt).otherwise(
        F.concat(F.lit(token + "\n"), prompt))


from scorebook._ship import ship  # noqa: E402

ship(__name__)
