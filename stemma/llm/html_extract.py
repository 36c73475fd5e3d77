"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks. Features of a block come from the
elements around it and from its text; the chain adds how likely main text
follows main text. The weights maximise the conditional likelihood of labelled
pages, and a page is decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.html_blocks import LANDMARKS, PHRASES, Block, leaf_blocks
from stemma.llm.html_pages import MAIN, REST, labelled_pages
from stemma.llm.tables import whole_row

#: Labelled pages that the field is trained on, and steps of the training.
TRAIN_PAGES = 600
STEPS = 150
DECAY = 1e-4


def _level(value: float, limits: tuple[float, ...]) -> int:
    return sum(value > limit for limit in limits)


def block_features(block: Block, before: Block | None) -> list[str]:
    """The names of the features that a block has."""
    tags = [e.tag for e in block.path]
    parts = {p for e in block.path for p in e.parts}
    inner = next((e for e in reversed(block.path) if e.tag in LANDMARKS or e.parts), None)
    mark = "none" if inner is None else "+".join(sorted(inner.parts)) or inner.tag
    landmark = next((t for t in reversed(tags) if t in LANDMARKS), "none")
    words = block.text.count(" ") + 1
    linked = _level(block.linked / max(len(block.text), 1), (0.05, 0.5, 0.9))
    last = tags[-1] if tags else "none"
    around = next((t for t in ("article", "main") if t in tags), "none")
    rest = parts - {"main"}
    out = [
        "bias",
        f"tag={last}",
        f"tag={last} around={around}",
        f"landmark={landmark}",
        f"landmark={landmark} around={around}",
        f"mark={mark}",
        f"words={_level(words, (2, 5, 10, 20, 50))}",
        f"linked={linked}",
        f"linked={linked} tag={last}",
        f"end={block.text[-1] in '.!?:;'}",
        f"around={around} main={'main' in parts}",
        f"rest={bool(rest)}",
    ]
    out += [f"in={t}" for t in set(tags) & LANDMARKS]
    out += [f"part={p}" for p in parts]
    out += [f"says={name} words={_level(words, (10, 40))}" for name, says in PHRASES.items() if says.search(block.text)]
    if before is not None:
        out.append(f"same={before.path == block.path}")
        out.append(f"parent={before.path[:-1] == block.path[:-1]}")
    return out


@dataclass
class Field:
    """Weights of features by label (0 rest, 1 main), of the first label, and of label pairs."""

    index: dict[str, int]
    weights: np.ndarray
    first: np.ndarray
    pairs: np.ndarray

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        best, back, index, before = None, [], self.index, None
        for block in blocks:
            known = [index[f] for f in block_features(block, before) if f in index]
            score = self.weights[known].sum(axis=0)
            before = block
            if best is None:
                best = self.first + score
                continue
            steps = best[:, None] + self.pairs
            back.append(steps.argmax(axis=0))
            best = steps.max(axis=0) + score
        if best is None:
            return []
        labels = [int(best.argmax())]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def read_labels(pages: list[str]) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of pages whose texts begin with MAIN or REST."""
    out = []
    for page in pages:
        blocks = [b for b in leaf_blocks(page) if b.text.strip(MAIN + REST)]
        labels = [int(b.text[0] == MAIN) for b in blocks]
        for b in blocks:
            b.text = b.text.strip(MAIN + REST)
        if blocks:
            out.append((blocks, labels))
    return out


def train_field(pages: list[str], steps: int = STEPS, decay: float = DECAY) -> Field:
    """Maximise the likelihood of the labels by Adam, all pages at once; a page is one row of padded arrays."""
    read = read_labels(pages)
    index: dict[str, int] = {}
    features, owner, n = [], [], 0
    longest = max(len(b) for b, _ in read)
    truth = np.zeros((len(read), longest), int)
    mask = np.zeros((len(read), longest), bool)
    for p, (blocks, labels) in enumerate(read):
        before = None
        for t, block in enumerate(blocks):
            for name in block_features(block, before):
                features.append(index.setdefault(name, len(index)))
                owner.append(p * longest + t)
            before = block
            truth[p, t], mask[p, t] = labels[t], True
    features, owner = np.array(features), np.array(owner)
    rows = np.arange(len(read))
    theta = np.zeros(2 * len(index) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, first, pairs = theta[: 2 * len(index)].reshape(-1, 2), theta[-6:-4], theta[-4:].reshape(2, 2)
        score = np.stack([np.bincount(owner, w[features, k], truth.size) for k in (0, 1)], -1).reshape(*truth.shape, 2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = first + score[:, 0]
        for t in range(1, longest):
            moved = _lse(ahead[:, t - 1, :, None] + pairs, 1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], moved, ahead[:, t - 1])
        total = _lse(ahead[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            moved = _lse(pairs + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], moved, 0.0)
        chance = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        wrong = chance.copy()
        wrong[rows[:, None], np.arange(longest)[None], truth] -= mask
        flat = wrong.reshape(-1, 2)
        grad = np.zeros_like(theta)
        grad[: 2 * len(index)] = np.stack([np.bincount(features, flat[owner, k], len(index)) for k in (0, 1)], -1).ravel()
        grad[-6:-4] = wrong[:, 0].sum(axis=0)
        both = mask[:, 1:]
        joint = np.exp(
            ahead[:, :-1, :, None] + pairs + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
        ) * both[..., None, None]
        grad[-4:] = joint.sum(axis=(0, 1)).ravel()
        np.subtract.at(grad[-4:], (truth[:, :-1] * 2 + truth[:, 1:])[both], 1)
        grad = grad / len(read) + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(index, theta[: 2 * len(index)].reshape(-1, 2).copy(), theta[-6:-4].copy(), theta[-4:].reshape(2, 2).copy())


def main_text(page: str, field: Field) -> str:
    """The main text of one page: its blocks in order, one line each; empty if there is none."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, field.decode(blocks)) if label)


def extract_main_text(
    pages: DataFrame, html_col: str = "html", field: Field | None = None, train_pages: int = TRAIN_PAGES
) -> DataFrame:
    """(row, text) for every row of ``pages``; ``row`` holds its columns, whatever their names.

    The whole page is read. A null or empty page, and one without main text,
    has an empty text. Repeated rows get equal texts. An empty table gives an
    empty result. Without a ``field`` one is trained on ``train_pages``
    invented pages, whatever the size of the table.
    """
    model = field or train_field(labelled_pages(train_pages))
    source = pages.select(
        whole_row(pages),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, model))

    return source.select("row", text_of("html").alias("text"))
