"""Detectors around models of other libraries: each is loaded once in a Python worker, and only there.

A `load` function returns the model; the adapters turn what the model says into predicted spans (start, end,
entity type, text). Texts without anything but white space are not shown to a model; spans' texts are cut
from the document, whatever the model calls them; labels without an entity type are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby
from typing import Any

from hushgrain.functions.labels import CONLL, MIN_SCORE, ONTONOTES, PRESIDIO
from hushgrain.operators.bio import LABELS
from hushgrain.operators.detect import Detector, model_detector, register

Spans = list[tuple[int, int, str, str]]


def _detector(load: Callable[[], Any], say: Callable[[Any, str], Iterable[tuple[int, int, str | None]]], labels: dict[str, str] | None) -> Detector:
    def loaded() -> Callable[[str], Spans]:
        model = load()

        def spans(text: str) -> Spans:
            if not text.strip():
                return []
            typed = ((int(a), int(z), labels.get(k) if labels is not None else k) for a, z, k in say(model, text))
            return [(a, z, k, text[a:z]) for a, z, k in typed if k is not None]

        return spans

    return model_detector(loaded)


def token_pipeline(load: Callable[[], Callable[[str], list[dict]]], labels: dict[str, str] = CONLL) -> Detector:
    """A pipeline that returns dicts with start, end and entity_group (or entity, where words aren't
    grouped)."""
    return _detector(load, lambda model, text: ((e["start"], e["end"], e.get("entity_group") or e.get("entity")) for e in model(text)), labels)


def entity_parser(load: Callable[[], Callable[[str], Any]], labels: dict[str, str] = ONTONOTES) -> Detector:
    """A parser whose documents have ents with start_char, end_char and label_."""
    return _detector(load, lambda model, text: ((e.start_char, e.end_char, e.label_) for e in model(text).ents), labels)


def scoring_analyser(load: Callable[[], Any], labels: dict[str, str] = PRESIDIO, min_score: float = MIN_SCORE, language: str = "en") -> Detector:
    """An analyser with analyze(text=, language=), whose results have start, end, entity_type and score;
    scores below min_score are dropped."""
    return _detector(load, lambda model, text: ((r.start, r.end, r.entity_type) for r in model.analyze(text=text, language=language) if r.score >= min_score), labels)


def labelled_spans(label_ids: Iterable[int], offsets: Iterable[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, entity type) of tokens with label ids: a B, or an I of another type than the token
    before, begins a span; tokens at (0, 0) are special and don't interrupt one."""
    tokens, run, before = [], 0, None
    for i, (a, z) in zip(label_ids, offsets):
        if (a, z) == (0, 0):
            continue
        prefix, _, kind = (LABELS[i] if 0 <= i < len(LABELS) else "O").partition("-")
        run += prefix == "B" or kind != before
        before = kind
        tokens.append((run, kind, a, z))
    parts = (list(g) for _, g in groupby(tokens, key=lambda t: t[0]))
    return [(p[0][2], p[-1][3], p[0][1]) for p in parts if p[0][1]]


def token_classifier(load: Callable[[], tuple[Callable, Callable]], max_length: int = 512, stride: int = 64) -> Detector:
    """A fine-tuned classifier in the labels of `bio`. load returns (tokenizer, classify): the tokenizer
    cuts long texts into windows of max_length tokens that share `stride`, classify gives each token of a
    window its label id. A span that several windows have counts once."""

    def say(model: tuple[Callable, Callable], text: str) -> list[tuple[int, int, str]]:
        tokenizer, classify = model
        coded = tokenizer(text, return_offsets_mapping=True, return_overflowing_tokens=True, truncation=True, max_length=max_length, stride=stride, padding=False)
        found = {span for ids, mask, offsets in zip(coded["input_ids"], coded["attention_mask"], coded["offset_mapping"]) for span in labelled_spans(classify(ids, mask), offsets)}
        return sorted(found)

    return _detector(load, say, None)


# Models by name


def _spacy(name: str | None) -> Detector:
    import importlib.util

    if importlib.util.find_spec("spacy") is None:
        raise ImportError("spacy isn't installed")

    def load():
        import spacy

        return spacy.load(name or "en_core_web_trf")

    return entity_parser(load)


def _transformers() -> None:
    import importlib.util

    if importlib.util.find_spec("transformers") is None:
        raise ImportError("transformers isn't installed")


def _hub_pipeline(name: str | None) -> Detector:
    _transformers()

    def load():
        from transformers import pipeline

        return pipeline("ner", model=name or "dslim/bert-base-NER", aggregation_strategy="simple")

    return token_pipeline(load)


def _fine_tuned(path: str | None) -> Detector:
    _transformers()
    if not path:
        raise ValueError("a fine-tuned model needs a path")

    def load():
        import torch
        from transformers import AutoModelForTokenClassification, AutoTokenizer

        device = "cuda" if torch.cuda.is_available() else "cpu"
        model = AutoModelForTokenClassification.from_pretrained(path).to(device).eval()

        def classify(ids: list[int], mask: list[int]) -> list[int]:
            with torch.no_grad():
                shown = {"input_ids": torch.tensor([ids], device=device), "attention_mask": torch.tensor([mask], device=device)}
                return model(**shown).logits[0].argmax(dim=-1).tolist()

        return AutoTokenizer.from_pretrained(path, add_prefix_space=True), classify

    return token_classifier(load)


for _name, _make in (("spacy", _spacy), ("hf", _hub_pipeline), ("finetuned", _fine_tuned)):
    register(_name, _make)
