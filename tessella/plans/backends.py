"""Where external models plug in: a backend maps batches of texts in Arrow workers and is created once in each worker.

The stand-ins are deterministic and are not translations; they exist to exercise plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.requests import DELIMITER, MARK, MAX_BYTES, MAX_CHARS, MAX_ITEMS


class Translator:
    """One text at a time; batches by default map it."""

    def translate(self, text: str, src: str, tgt: str) -> str:
        raise NotImplementedError

    def translate_batch(self, texts: list[str], src: str, tgt: str) -> list[str]:
        return [self.translate(t, src, tgt) for t in texts]

    def unload(self) -> None:
        """Frees what the backend holds."""


class Identity(Translator):
    """Stand-in: the text itself."""

    def translate(self, text: str, src: str, tgt: str) -> str:
        return text


class Marked(Translator):
    """Stand-in: the text in upper case behind the language pair."""

    def translate(self, text: str, src: str, tgt: str) -> str:
        return f"[{src}>{tgt}] {text.upper()}"


class Brittle(Translator):
    """Stand-in: the text behind the language pair; fails beyond 3000 characters."""

    def translate(self, text: str, src: str, tgt: str) -> str:
        if len(text) > 3000:
            raise ValueError(f"{len(text)} characters")
        return f"[{src}>{tgt}] {text}"


class Delimited(Translator):
    """Sends texts in requests within a budget, joined by a delimiter; if a reply doesn't come apart into as many, its texts go one by one."""

    def __init__(self, inner: Translator):
        self.inner = inner

    def translate(self, text: str, src: str, tgt: str) -> str:
        return self.inner.translate(text, src, tgt)

    def translate_batch(self, texts: list[str], src: str, tgt: str) -> list[str]:
        clean, groups, size = [t.replace(MARK, " ").strip() for t in texts], [], (0, 0)
        for i, t in enumerate(clean):
            more = (len(t) + len(DELIMITER), len(t.encode()) + len(DELIMITER))
            fits = groups and len(t) < MAX_CHARS and size[0] + more[0] <= MAX_CHARS and size[1] + more[1] <= MAX_BYTES and len(groups[-1]) < MAX_ITEMS
            if fits:
                groups[-1].append(i)
                size = (size[0] + more[0], size[1] + more[1])
            else:
                groups.append([i])
                size = (len(t), len(t.encode()))
        out = [""] * len(texts)
        for g in groups:
            parts = [p.strip() for p in self.inner.translate(DELIMITER.join(clean[i] for i in g), src, tgt).split(MARK)] if len(g) > 1 else []
            if len(parts) != len(g):
                parts = self.inner.translate_batch([clean[i] for i in g], src, tgt)
            if len(parts) != len(g):
                parts = [self.inner.translate(clean[i], src, tgt) for i in g]
            for i, p in zip(g, parts):
                out[i] = p.strip()
        return out

    def unload(self) -> None:
        self.inner.unload()


FACTORIES: dict[str, Callable[[], Translator]] = {"identity": Identity, "marked": Marked, "brittle": Brittle}


def register(name: str, factory: Callable[[], Translator]) -> None:
    FACTORIES[name] = factory


def translated(df: DataFrame, factory: Callable[[], Translator] | dict, out: str = "hypothesis", errors: str | None = None) -> DataFrame:
    """Adds out for df(text, src, tgt): blank texts stay blank, failed ones become null. errors: a further column for what was raised.

    factory: of one backend for all rows, or a dict of factories by the name in the column backend, with None for all other names. A worker creates
    a backend when its first row comes."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` string", *([f"`{errors}` string"] if errors else [])])
    by_name = factory if isinstance(factory, dict) else {None: factory}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict = {}
        for b in batches:
            got: list = [""] * len(b)
            raised: list = [None] * len(b)
            names = b["backend"] if isinstance(factory, dict) else [None] * len(b)
            calls: dict = {}
            for i, (t, name) in enumerate(zip(b["text"], names)):
                if t is not None and t.strip():
                    calls.setdefault((name if name in by_name else None, b["src"].iat[i], b["tgt"].iat[i]), []).append(i)
            for (name, src, tgt), rows in calls.items():
                try:
                    backend = made.get(name) or made.setdefault(name, by_name[name]())
                    replies = backend.translate_batch([b["text"].iat[i] for i in rows], src, tgt)
                    if len(replies) != len(rows):
                        raise ValueError(f"{len(replies)} replies to {len(rows)} texts")
                    for i, t in zip(rows, replies):
                        got[i] = t
                except Exception as whole:  # a failing text fails itself, not its batch, and no text fails the job
                    for i in rows:
                        try:
                            if name not in made:
                                raise whole
                            got[i] = made[name].translate(b["text"].iat[i], src, tgt)
                        except Exception as e:
                            got[i], raised[i] = None, f"{type(e).__name__}: {e}"
            yield b.assign(**{out: got} | ({errors: raised} if errors else {}))
        for backend in made.values():
            backend.unload()

    return df.mapInPandas(run, schema)


def marked(c: Column) -> Column:
    """Stand-in translation as a column: lower case without vowels."""
    return F.regexp_replace(F.lower(c), "[aeiou]", "")
