"""Behaviour profiles: which rules, weights and gates a run uses. The profile is always an explicit parameter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """`score` weighs shared tokens by class; `gate` says which classes let a candidate in."""

    name: str
    clean: str = "plain"  # plain | hygiene | hygiene_hyphen
    names: str = "legal"  # legal | descriptors | harmonised | as_is
    addresses: str = "package"
    states: str = "package"
    house: str = "first_part"  # first_part | cascade
    score: tuple[tuple[str, float], ...] = (("len1", 1.0), ("gt1", 4.0), ("addr", 2.0), ("state", 2.0))
    gate: tuple[str, ...] = ("len1", "gt1", "addr")
    top_k: int = 15
    jaccard_digits: int | None = None
    address_words_over_one: bool = False
    substring_least: int = 3
    exact_needs_text: bool = True
    candidate_house: bool = True
    threshold: float = 0.75

    @property
    def weights(self) -> dict[str, float]:
        return dict(self.score)


PACKAGE = Profile("package")
PACKAGE_STRICT = Profile("package_strict", candidate_house=False)
NOTEBOOK = Profile("notebook", clean="hygiene", names="descriptors", addresses="notebook", states="notebook", house="cascade", jaccard_digits=3, address_words_over_one=True, substring_least=1)
#: Counts whole names instead of token classes.
FORMULA_A = Profile("formula_a", clean="hygiene", names="descriptors", addresses="notebook", states="notebook", house="cascade", score=(("name", 2.0), ("addr", 1.0), ("state", 1.0)), gate=("name", "addr"), jaccard_digits=3, address_words_over_one=True, substring_least=1)
BULK = Profile("bulk", clean="hygiene_hyphen", names="as_is", addresses="bulk", states="bulk", exact_needs_text=False)
GATED = Profile("gated", clean="hygiene", names="harmonised", addresses="notebook", states="gated", house="cascade", score=(("generic", 1.0), ("len1", 2.0), ("brand", 8.0), ("addr", 4.0), ("state", 4.0)), gate=("generic", "len1", "brand"), jaccard_digits=3, address_words_over_one=True, substring_least=1)
PROFILES = {p.name: p for p in (PACKAGE, PACKAGE_STRICT, NOTEBOOK, FORMULA_A, BULK, GATED)}
