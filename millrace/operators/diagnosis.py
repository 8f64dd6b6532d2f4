"""Reading of training logs and status files: progress, loss, errors and the state of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_N, _V, _REST = r"(\d+)", r"\s*'([^']+)'", r"[^\r\n]*?"
_PROGRESS = rf"{_N}%\|{_REST}\|\s*{_N}/{_N}"
_LOSS = rf"\{{'loss':{_V}" + "".join(f"{_REST}'{k}':{_V}" for k in ("learning_rate", "epoch"))
LINE_CHARS = 1200

#: Category, what its lines contain, and what to do; the first that the log contains counts.
CHECKS = [
    ("CUDA 显存溢出", ["cuda out of memory", "torch.outofmemoryerror", "memory mapping failed with oom"], ["降低 TRAIN_BATCH_SIZE 并相应提高 GRADIENT_ACCUMULATION_STEPS；确认梯度检查点已启用。", "用 nvidia-smi 确认没有别的进程占用训练 GPU。"]),
    ("磁盘空间不足", ["disk quota exceeded", "no space left on device"], ["用 df -h 与 du -sh 检查模型、checkpoint、日志所在的磁盘。"]),
    ("NCCL/GPU 通信错误", ["ncclerror", "nccl error", "unhandled system error"], ["单卡训练时 GPU_IDS 只填一个编号；检查驱动、CUDA 和 GPU 状态。"]),
    ("训练数值异常", ["nan loss", "loss': 'nan", "loss\": \"nan", "grad_norm': 'nan"], ["检查异常样本和学习率；不要从出现 NaN 之后的节点恢复。"]),
    ("进程被系统终止", ["sigkill", "signal 9", "killed"], ["检查内存、作业时限与调度器日志。"]),
    ("数据或 JSON 解析错误", ["failed to read data", "jsondecodeerror", "error when tokenizing data"], ["检查报错行附近的 JSONL；instruction、input、output 都应是字符串。"]),
    ("Python 运行异常", ["modulenotfounderror:", "traceback (most recent call last)"], ["关键异常见下；不够时查看日志末尾 80 行。"]),
    ("启动或配置检查失败", ["permission denied", "error: 找不到", "错误："], ["按关键错误修正路径、权限、依赖或参数后重新训练。"]),
]
_PYTHON = "Python 运行异常"
_RAISED = [f"{x}:" for x in "error exception typeerror valueerror runtimeerror".split()]


def last_match(text: Column, pattern: str, groups: int) -> Column:
    """The groups of the last match as an array; null without one."""
    p = F.lit(pattern)
    return F.when(F.regexp_count(text, p) > 0, F.array(*[F.element_at(F.regexp_extract_all(text, p, i + 1), -1) for i in range(groups)]))


def last_line(text: Column, parts: list[str]) -> Column:
    """The last line that contains one of the parts, in any case."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), lambda x: _contains(F.lower(x), parts))
    return F.when(F.size(lines) > 0, F.substring(F.trim(F.element_at(lines, -1)), 1, LINE_CHARS))


def _contains(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p.lower()))
    return out


def diagnosed(logs: DataFrame, text: str = "text") -> DataFrame:
    """logs with progress (percent, step, total), metrics (loss, learning rate, epoch), the category of
    the first error that fits, its last line, and whether the log says that training ended."""
    c, low = F.col(text), F.lower(text)
    category, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, parts, _ in reversed(CHECKS):
        line = last_line(c, parts)
        if name == _PYTHON:
            line = F.coalesce(last_line(c, _RAISED), line)
        category = F.when(_contains(low, parts), name).otherwise(category)
        detail = F.when(_contains(low, parts), line).otherwise(detail)
    return logs.withColumns({
        "progress": last_match(c, _PROGRESS, 3).try_cast("array<bigint>"), "metrics": last_match(c, _LOSS, 3), "category": category, "detail": detail,
        "ended": F.contains(c, F.lit("train_runtime")) & F.contains(c, F.lit("train_loss")),
    })


def state(recorded: str | None, alive: bool, category: str | None, ended: bool) -> str:
    """What a run's state is, from the recorded one, whether its process lives, and its log."""
    if recorded == "RUNNING":
        return "RUNNING" if alive else "UNEXPECTED_STOP"
    if recorded in ("COMPLETED", "FAILED"):
        return recorded
    if alive:
        return "RUNNING"
    out = recorded or "UNKNOWN"
    return out if out != "UNKNOWN" else "FAILED" if category else "COMPLETED" if ended else out


EXIT = {"RUNNING": 0, "COMPLETED": 0, "FAILED": 2, "UNEXPECTED_STOP": 2}


def report(spark: SparkSession, tail: str, status: dict, alive: bool, checkpoints: list[str], **places: str | None) -> dict:
    """The report on a run: state, progress, metrics, checkpoints, the error and what to do about it.
    places: status_file, log_file and output_dir, as the report names them."""
    row = diagnosed(spark.createDataFrame([(tail,)], "text string")).first()
    at = state(status.get("state"), alive, row.category, row.ended)
    todo = next((s for n, _, s in CHECKS if n == row.category), [])
    known = {k: status.get(k) for k in ("pid", "exit_code", "started_at", "ended_at")}
    return {
        "state": at, "recorded_state": status.get("state"), "pid_alive": alive, **known, **{k: places.get(k) for k in ("output_dir", "log_file", "status_file")},
        "progress": row.progress and dict(zip(("percent", "step", "total_steps"), row.progress)), "metrics": row.metrics and dict(zip(("loss", "learning_rate", "epoch"), row.metrics)),
        "latest_checkpoint": checkpoints[-1] if checkpoints else None, "checkpoint_count": len(checkpoints), "error_category": row.category, "error_detail": row.detail, "suggestions": todo,
    }


_STATES = {"RUNNING": "运行中", "COMPLETED": "正常完成", "FAILED": "异常退出", "UNEXPECTED_STOP": "进程已不在", "UNKNOWN": "没有状态"}


def readable(found: dict) -> str:
    """A report as lines of text; what isn't known is left out."""
    rows = [("状态", _STATES.get(found["state"], found["state"])), ("PID", found["pid"]), ("退出码", found["exit_code"]), ("开始时间", found["started_at"]), ("结束时间", found["ended_at"]), ("日志", found["log_file"]), ("输出目录", found["output_dir"])]
    if p := found["progress"]:
        rows.append(("最后进度", f"{p['step']}/{p['total_steps']}（{p['percent']}%）"))
    if found["metrics"]:
        rows.append(("最近指标", "，".join(f"{k}={v}" for k, v in found["metrics"].items())))
    rows += [("检查点数", found["checkpoint_count"]), ("最近检查点", found["latest_checkpoint"]), ("错误类型", found["error_category"]), ("关键错误", found["error_detail"])]
    rows += [("建议", s) for s in found["suggestions"]]
    return "\n".join(f"{k}：{v}" for k, v in rows if v is not None)


def updated_status(old: dict, **fields) -> dict:
    """A status document with fields set; those that are None stay as they are."""
    return old | {k: v for k, v in fields.items() if v is not None}
