"""Prompts, chat rendering and label masks as expressions over text and id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt templates by task.
TEMPLATES = {
    "asr": [
        "{audio_token} Transcribe this audio in {lang}.",
        "Transcribe the following {lang} audio: {audio_token}",
        "{audio_token} Write down what is said in this {lang} recording.",
        "Listen to this {lang} audio and transcribe it: {audio_token}",
        "{audio_token} Provide a transcription of the {lang} speech.",
        "What is being said in this {lang} audio? {audio_token}",
        "{audio_token} Transcribe this audio.",
        "Transcribe the following audio: {audio_token}",
        "{audio_token} Write down what is said in this recording.",
        "Listen to this audio and transcribe it: {audio_token}",
        "{audio_token} Provide a transcription of the speech.",
        "What is being said in this audio? {audio_token}",
    ],
    "st": [
        "{audio_token} Translate this audio to {lang}.",
        "Translate the following audio into {lang}: {audio_token}",
        "{audio_token} Provide a translation of this speech to {lang}.",
        "Listen to this audio and translate it to {lang}: {audio_token}",
        "{audio_token} What is being said? Translate into {lang}.",
        "Convert the speech in this audio to {lang}: {audio_token}",
    ],
    "speechqe": [
        "{audio_token} Score how well this {lang} translation matches the audio. Return a float between 0 and 1.",
        "Given this audio and its {lang} translation, provide a quality score from 0 to 1: {audio_token}",
        "{audio_token} Evaluate the quality of the following {lang} translation for this speech and answer with a single float in [0, 1].",
        "Listen to this audio, assess the provided {lang} translation, and output only a float between 0 and 1: {audio_token}",
    ],
}

# Strings that open and close an assistant's turn.
BOUNDARIES = {
    "chatml": ("<|im_start|>assistant\n", "<|im_end|>\n"),
    "llama3": ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"),
}
IGNORED = -100


def boundaries(name: str) -> tuple[str, str]:
    if name not in BOUNDARIES:
        raise ValueError(f"unknown chat template {name!r}; known: {sorted(BOUNDARIES)}")
    return BOUNDARIES[name]


def chosen_template(task: str, key: Column, mode: str = "random", seed: int = 42, custom: str | dict | None = None) -> Column:
    """A template for each key by hash; with_language only offers those that name the language."""
    if mode == "custom":
        return F.lit(custom[task] if isinstance(custom, dict) else custom)
    offered = [t for t in TEMPLATES[task] if mode == "random" or "{lang}" in t]
    if not offered:
        raise ValueError("no template names the language")
    place = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(len(offered)))
    return F.element_at(F.array(*[F.lit(t) for t in offered]), (place + 1).cast("int"))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def chat(role: Column, text: Column, name: str = "chatml") -> Column:
    """One rendered turn."""
    boundaries(name)
    if name == "chatml":
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    return F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"), text, F.lit("<|eot_id|>"))


def keep_spans(ids: Column, start: list[int], end: list[int]) -> Column:
    """Ids of spans from ``start`` to ``end`` (both kept, repeated, an open tail kept), others -100; one fold over places."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    begins = lambda i: F.slice(ids, i + 1, len(start)) == lit(start)
    ends = lambda i: (i + 1 >= len(end)) & (F.slice(ids, F.greatest(i + 2 - len(end), F.lit(1)), len(end)) == lit(end))
    state = F.struct(F.lit(False).alias("open"), F.lit(0).alias("body"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        i = x["i"]
        opens = ~s["open"] & begins(i)
        on = s["open"] | opens
        body = F.when(opens, i + len(start)).otherwise(s["body"])
        closes = on & (i + 1 >= body + len(end)) & ends(i)
        return F.struct((on & ~closes).alias("open"), body.alias("body"), F.concat(s["out"], F.array(F.when(on, x["t"]).otherwise(IGNORED).cast("int"))).alias("out"))

    places = F.transform(ids, lambda t, i: F.struct(t.cast("int").alias("t"), i.alias("i")))
    return F.aggregate(places, state, step, lambda s: s["out"])


def mask_prompt(ids: Column, spans: Column, prompt_chars: Column) -> Column:
    """-100 for tokens whose character span ends inside the prompt; empty (0, 0) spans and straddlers stay."""
    inside = lambda s: ((s["start"] != 0) | (s["end"] != 0)) & (s["end"] <= prompt_chars)
    return F.zip_with(ids, spans, lambda t, s: F.when(inside(s), IGNORED).otherwise(t))


def mask_ids(ids: Column, special: list[int]) -> Column:
    return F.transform(ids, lambda t: F.when(t.isin(special), IGNORED).otherwise(t))


def unmask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda t: F.when(t == IGNORED, pad).otherwise(t))


def padded(ids: Column, size: Column, pad: int, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def placeholder_count(text: Column, token: str) -> Column:
    return F.size(F.split(text, "\\Q" + token + "\\E", -1)) - 1


def expanded(text: Column, token: str, n: Column) -> Column:
    """Each placeholder repeated ``n`` times."""
    return F.replace(text, F.lit(token), F.repeat(F.lit(token), n.cast("int")))


def surrounded(text: Column, token: str, before: str, after: str) -> Column:
    return F.replace(text, F.lit(token), F.lit(before + token + after))


def check_boundaries(name: str, probe: str) -> list[str]:
    """Problems of a rendered probe conversation: a boundary that is not there, or text put before the content."""
    start, end = boundaries(name)
    out = [f"{label} {b!r} does not occur" for label, b in (("start", start), ("end", end)) if b not in probe]
    if not out and not probe.split(start, 1)[1].startswith("PROBE"):
        out.append("text stands before the assistant's content")
    return out
