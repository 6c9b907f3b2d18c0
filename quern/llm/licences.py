"""Licence scans: a trained paragraph classifier confirmed by templates (DataFrame functions only).

Paragraphs are lines, with lines that go on from the one before (hard-wrapped notices, comment marks in front of them
included) joined to it.  A paragraph is a set of word 1- and 2-grams.  Sparse multinomial logistic regression, fitted with an
L1 penalty on labelled paragraphs (``licence_texts.NOTICES`` in varied surroundings, tags in several notations, and paragraphs that name no
known licence), gives each family's probability, with a class ``unknown`` of its own and a temperature fitted on
paragraphs kept apart.  A prediction stands only if a template of that family confirms it: enough of the template's n-grams are
in the paragraph, or the paragraph is a piece of the template.

Every template holds an anchor word, so paragraphs without any anchor cannot be confirmed and are passed over by one pattern.
The scan is one narrow projection: no shuffle, whatever the number of paragraphs of a document.

Edge cases: a null or empty text has no paragraphs; equal probabilities go to the first family in order of name; repeated
rows are scanned alike; columns of docs are carried through unless they clash with ``licences`` or ``n_paragraphs``,
in which case the outputs win; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.licence_texts import FILLER, NOTICES, OTHER, TAGS, TEMPLATES

UNKNOWN = "unknown"
WORDS = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Words one of which every paragraph with a licence holds.
ANCHOR = r"(?i)licen[cs]|copyright|permi(?:ssion|tted)|redistribut|rights? reserved|public (?:domain|license)|warrant|spdx|cc.?by|cc0|creative commons|(?-i:\bMIT\b)|documentation files|mozilla|eupl|unencumbered|granted|prohibited|endorse|compiled binary|sublicense|substantial portions"
#: A line end inside a sentence: the next line goes on in small letters, or this line is long and unfinished.
MARKS = r"[ \t]*(?:(?:#+|\*+|//+|;+|--+|%+)[ \t]+)?"
WRAP = rf"(?=[ \t]*+\r?\n)(?:(?<![.!?:;|\s])[ \t]*+\r?\n{MARKS}(?=[a-z(\"'0-9])|(?<=[^\n]{{45}}[^\n.!?:;|\s])[ \t]*+\r?\n{MARKS}(?=[A-Z(\"'0-9]))"
#: Words from which a paragraph can be taken for a piece of a template.
PIECE = 8


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def grams(text: str) -> list[str]:
    """Distinct word 1- and 2-grams, as the scan's expressions make them."""
    words = words_of(text)
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def all_templates() -> dict[str, list[str]]:
    """Titles and sentences of each family, and its tags as licence identifiers write them."""
    return {f: [*TEMPLATES[f], *(f"SPDX-License-Identifier: {t}" for t in TAGS.get(f, []))] for f in sorted(TEMPLATES)}


def labelled_paragraphs(per_notice: int = 10, seed: int = 17) -> list[tuple[str, str]]:
    """(paragraph, family): notices and tags in varied surroundings, and paragraphs that name no known licence."""
    r = random.Random(seed)
    pad = lambda most: " ".join(r.choice(FILLER) for _ in range(r.randint(0, most)))
    found = []
    for family, notices in NOTICES.items():
        tags = [form.format(t) for t in TAGS.get(family, []) for form in ("License: {}", "license = \"{}\"", "License-Identifier: {}", "licensed {}")]
        for t in notices + tags:
            for k in range(per_notice if t in notices else max(2, per_notice // 3)):
                words = t.split()
                if k % 5 == 4 and len(words) > 8:  # pieces of long notices
                    at = r.randrange(len(words) // 2)
                    words = words[at : at + max(8, len(words) // 2)]
                found.append((f"{pad(6)} {' '.join(words)} {pad(6)}".strip(), family))
    for t in OTHER:
        found += [(f"{pad(6)} {t} {pad(6)}".strip(), UNKNOWN) for _ in range(per_notice)]
    found += [(pad(14) or "text", UNKNOWN) for _ in range(8 * per_notice)]
    return found


class LicenceModel:
    def __init__(self, families: list[str], bias: np.ndarray, weights: dict[str, np.ndarray], temperature: float):
        self.families, self.bias, self.weights, self.temperature = families, bias, weights, temperature


_fitted: dict = {}


def train(per_notice: int = 10, l1: float = 5e-5, rounds: int = 250) -> LicenceModel:
    """Accelerated proximal gradient on the labelled paragraphs; every fifth sets the temperature."""
    if (per_notice, l1, rounds) in _fitted:
        return _fitted[per_notice, l1, rounds]
    rows = labelled_paragraphs(per_notice)
    families = sorted({f for _, f in rows})
    vocabulary: dict[str, int] = {}
    members = [[vocabulary.setdefault(g, len(vocabulary)) for g in grams(t)] for t, _ in rows]
    x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
    for i, m in enumerate(members):
        x[i, m] = 1.0
    x[:, -1] = 1.0
    y = np.array([families.index(f) for _, f in rows])
    apart = np.arange(len(rows)) % 5 == 3
    xt, hot = x[~apart], np.eye(len(families), dtype=np.float32)[y[~apart]]
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the greatest singular value, by the power method
        v = xt.T @ (xt @ v)
        top = float(np.linalg.norm(v))
        v /= top
    speed = 2.0 * len(xt) / top
    w = ahead = np.zeros((x.shape[1], len(families)), np.float32)
    for k in range(rounds):
        z = xt @ ahead
        e = np.exp(z - z.max(1, keepdims=True))
        new = ahead - speed * xt.T @ (e / e.sum(1, keepdims=True) - hot) / len(xt)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - speed * l1, 0)
        ahead, w = new + (k / (k + 3)) * (new - w), new
    z, target = x[apart] @ w, y[apart]

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), target]).mean())

    temperature = min((2.0 ** (k / 4) for k in range(-12, 13)), key=loss)
    weights = {g: np.round(w[i].astype(np.float64), 4) for g, i in vocabulary.items() if np.abs(w[i]).max() > 5e-5}
    model = _fitted[per_notice, l1, rounds] = LicenceModel(families, np.round(w[-1].astype(np.float64), 4), weights, temperature)
    return model


def _listed(values) -> Column:
    """A constant array of strings, folded once."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _numbers(text: Column) -> Column:
    return F.split(text, ",").cast("array<double>")


def scan_licences(docs: DataFrame, text_col: str = "text", match: float = 0.75, threshold: float = 0.5) -> DataFrame:
    """docs with n_paragraphs and ``licences``: for each anchored paragraph its place, family (confirmed, or unknown), probability and template match."""
    model = train()
    families = model.families
    templates = {f: [grams(t) for t in ts] for f, ts in all_templates().items()}
    kept = [c for c in docs.columns if c not in ("licences", "n_paragraphs")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = sorted(model.weights)
    spelled = [",".join(f"{v:.4f}" for v in model.weights[g]) for g in names]
    table = F.map_from_arrays(_listed(names), _listed(spelled))
    zeros = F.lit(",".join("0" for _ in families))
    vocabulary = _listed(sorted({*names, *(g for ts in templates.values() for t in ts for g in t)}))

    lines = F.split(F.regexp_replace(text, WRAP, " "), "\n")
    numbered = F.transform(F.col("_lines"), lambda x, i: F.struct(i.alias("paragraph"), x.alias("text")))
    some = F.when(text.rlike(ANCHOR), F.filter(numbered, lambda p: p["text"].rlike(ANCHOR))).otherwise(F.filter(numbered, lambda p: F.lit(False)))

    def gram_sets(p: Column) -> Column:
        words = F.regexp_extract_all(F.lower(p["text"]), F.lit(WORDS), F.lit(0))
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        return F.struct(p["paragraph"].alias("paragraph"), F.size(words).alias("words"), F.array_union(words, pairs).alias("all"))

    def known(p: Column) -> Column:
        return F.struct(p["paragraph"].alias("paragraph"), p["words"].alias("words"), F.size(p["all"]).cast("double").alias("size"), F.array_intersect(p["all"], vocabulary).alias("grams"))

    def logits(p: Column) -> Column:
        z = F.aggregate(p["grams"], _numbers(F.lit(",".join(f"{v:.4f}" for v in model.bias))), lambda s, g: F.zip_with(s, _numbers(F.coalesce(F.try_element_at(table, g), zeros)), lambda a, b: a + b))
        return p.withField("z", F.transform(z, lambda v: v / F.lit(model.temperature)))

    def choice(p: Column) -> Column:
        top = F.array_max(p["z"])
        place = F.array_position(p["z"], top).cast("int")
        probability = F.lit(1.0) / F.aggregate(p["z"], F.lit(0.0), lambda s, v: s + F.exp(v - top))
        return p.dropFields("z").withField("family", F.element_at(_listed(families), place)).withField("probability", probability)

    def confirm(p: Column) -> Column:
        share = F.lit(0.0)
        for family, listed in templates.items():
            held = [(F.size(F.array_intersect(_listed(t), p["grams"])).cast("double"), float(len(t))) for t in listed]
            piece = F.when(p["words"] >= PIECE, F.lit(1.0) / p["size"]).otherwise(F.lit(0.0))
            best = F.greatest(*[h * F.greatest(F.lit(1.0 / n), piece) for h, n in held], F.lit(0.0))
            share = F.when(p["family"] == family, best).otherwise(share)
        return F.struct(p["paragraph"].alias("paragraph"), p["family"].alias("family"), p["probability"].alias("probability"), share.alias("match"))

    def settle(p: Column) -> Column:
        sure = (p["match"] >= match) & (p["probability"] >= threshold)
        return F.struct(p["paragraph"].alias("paragraph"), F.when(sure, p["family"]).otherwise(F.lit(UNKNOWN)).alias("family"), F.round(p["probability"], 6).alias("probability"), F.round(F.least(p["match"], F.lit(1.0)), 6).alias("match"))

    found = some
    for step in (gram_sets, known, logits, choice, confirm, settle):
        found = F.transform(found, step)
    split = docs.select(*kept, lines.alias("_lines"))
    return split.select(*kept, F.when(F.length(text) > 0, F.size("_lines")).otherwise(0).cast("long").alias("n_paragraphs"), found.alias("licences"))
