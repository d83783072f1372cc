"""Chart data, and pictures of it (which need matplotlib)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from sievewright.functions import coerce as c
from sievewright.functions.text import slug
from sievewright.operators import dependencies, profile
from sievewright.roles import Roles


def chart_frames(df: DataFrame, roles: Roles = Roles(), compat: bool = False) -> dict[str, DataFrame]:
    """name -> small frame: missing values, three distributions, two dependency charts. compat: nulls count as text."""
    texts = [x for x in (roles.name, roles.alias, roles.address, roles.category, roles.risk, roles.result, roles.kind) if x in df.columns]
    clean = c.strip_upper_text if compat else (lambda x: c.strip_upper(x.cast("string")))
    view = df.withColumns({x: clean(c.col(x)) for x in texts} | ({roles.zip: c.to_number(c.col(roles.zip))} if roles.zip in df.columns else {}))
    pairs = dependencies.chart_pairs(roles)
    frames = {"missing_value_percentage": profile.missing_percentage(view)}
    frames |= {f"category_distribution_{slug(x)}": profile.category_distribution(view, x, n) for x, n in ((roles.result, 10), (roles.risk, 10), (roles.category, 15))}
    frames |= {"fd_confidence_ranking": dependencies.confidence_ranking(view, pairs), "fd_violation_counts": dependencies.violation_counts(view, pairs)}
    return {k: v for k, v in frames.items() if v is not None}


def draw(frames: dict[str, DataFrame], folder: str, dpi: int = 300) -> list[Path]:
    """A bar chart a frame, as PNG, by matplotlib. The frames are collected: they are small."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, frame in frames.items():
        rows = frame.toPandas()
        fig, ax = plt.subplots(figsize=(10, max(3, 0.35 * len(rows))), facecolor="white")
        ax.barh(rows[rows.columns[0]].astype(str), rows[rows.columns[1]])
        if name == "fd_confidence_ranking":
            ax.set_xlim(0.85, 1.01)
        ax.set_title(name.replace("_", " "))
        fig.tight_layout()
        out.append(Path(folder) / f"{name}.png")
        fig.savefig(out[-1], dpi=dpi)
        plt.close(fig)
    return out
