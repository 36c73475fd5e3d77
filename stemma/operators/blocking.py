"""Which evidence a pair needs to reach the threshold, derived from the weights.

Every rule has a highest score. A pair without certain evidence must make up
for it with its name score, so each kind of evidence turns into join keys plus
the least name similarity to look for. No pair that could reach the threshold
is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from stemma.operators import pair_rules as R

# Name similarities below this are not looked up; the other keys stand alone then.
LOWEST_TOKEN = 0.56


@dataclass(frozen=True)
class Branch:
    """One family of join keys.

    ``links`` is the number of shared links in the key (0, 1 or 2); ``needs``
    maps (birth far, death far) to the least name score. ``place`` is the
    relation of the birth places that the key asks for: "same", "related" (one
    text holds the other), or None for any.
    """

    links: int
    birth: bool
    death: bool
    needs: dict
    place: str | None = None

    @property
    def least(self) -> float:
        return min(self.needs.values())

    @property
    def by_token(self) -> bool:
        return self.links < 2 and self.least >= LOWEST_TOKEN

    @property
    def other_least(self) -> float:
        """Least similarity of the weaker name part when both are present."""
        return other_part(self.least)

    @property
    def by_both(self) -> bool:
        return self.by_token and self.other_least >= LOWEST_TOKEN


def other_part(name: float) -> float:
    return math.ceil(((name - 0.005 - R.NAME_HIGH) / R.NAME_LOW) * 100 - 1e-6) / 100


#: Score of each relation of birth places.
PLACES = {"same": R.PLACE_SAME, "related": R.PLACE_RELATED, None: 0.0}


#: What the rules about relatives give two persons who have such relatives and share none of them.
APART = {"parents": R.PARENTS_DIFFER, "marriage": R.MARRIAGE_DIFFER, "children": R.CHILDREN_DIFFER}


def least_name(
    settings: R.Settings, links: int, birth: float, death: float, place: str | None = "same", lacking: tuple[str, ...] = ()
) -> float:
    """Least name score (two decimals) of a candidate with this evidence.

    ``lacking`` names rules that give nothing, as one of the two has no such relatives.
    """
    w = settings.weight

    def gain(shared: tuple[str, ...]) -> float:
        return sum(w(rule) * (1.0 if rule in shared else apart) for rule, apart in APART.items() if rule not in lacking)

    # Two or more shared links: any number of them may be shared.
    groups = [g for n in ({0: [0], 1: [1], 2: [2, 3]}[links]) for g in combinations(APART, n)]
    best = max(gain(g) for g in groups)
    best += w("birth") * birth + w("death") * death
    best += w("place") * PLACES[place] if settings.use_place else 0.0
    best += sum(rule.weight * rule.ceiling for rule in settings.custom)
    wanted = (settings.threshold - 0.0005) * settings.total_weight - 1e-9 - best
    if w("name") <= 0:
        return 2.0 if wanted > 0 else 0.0
    return math.ceil(wanted / w("name") * 100 - 1e-6) / 100


def _needs(
    settings: R.Settings, links: int, birth: bool, death: bool, place: str | None, lacking: tuple[str, ...] = ()
) -> dict:
    needs = {}
    for far_birth in (0, 1) if birth else (0,):
        for far_death in (0, 1) if death else (0,):
            birth_score = (R.OVERLAP if far_birth else R.SAME_YEAR) if birth else 0.0
            death_score = (R.NEXT_YEAR if far_death else R.SAME_YEAR) if death else 0.0
            need = least_name(settings, links, birth_score, death_score, place, lacking)
            if need <= 1.0:
                needs[(far_birth, far_death)] = max(0.0, need)
    return needs


def needs_lacking(settings: R.Settings, branch: Branch, lacking: tuple[str, ...]) -> dict:
    """The needs of a branch for a person to whom the ``lacking`` rules about relatives give nothing."""
    return _needs(settings, branch.links, branch.birth, branch.death, branch.place, lacking)


def branches(settings: R.Settings) -> list[Branch]:
    """All key families that can hold a candidate.

    A pair without a common relative has a branch per relation of the birth
    places, if places count: the nearer the places, the less the names must
    agree, and the place is part of the key. Where relatives are the key,
    places may stand as they like.
    """
    found = []
    for links in (0, 1, 2):
        if links == 2:
            if least_name(settings, 2, 1.0, 1.0) <= 1.0:
                found.append(Branch(2, False, False, {(0, 0): max(0.0, least_name(settings, 2, 1.0, 1.0))}))
            continue
        for birth in (True, False):
            for death in (True, False):
                if links == 1 or not settings.use_place:
                    kinds = {None: _needs(settings, links, birth, death, "same")}
                else:
                    kinds = {place: _needs(settings, links, birth, death, place) for place in PLACES}
                for place, needs in kinds.items():
                    # A place adds nothing where the names must agree no less without it.
                    if needs and not (place and needs == kinds[None]):
                        found.append(Branch(links, birth, death, needs, place))
    for branch in found:
        keyed = branch.birth or branch.death or (branch.place and branch.by_token)
        if branch.links == 0 and not keyed:
            raise ValueError(
                "with these weights two persons that share neither dates nor relatives can be "
                "candidates, so no key finds them all; raise the threshold or lower the name weight"
            )
    return found


def dictionary_least(found: list[Branch]) -> float | None:
    """Least similarity the name dictionary must hold; None when no branch uses it."""
    wanted = [b.least for b in found if b.by_token] + [b.other_least for b in found if b.by_both]
    return min(wanted) if wanted else None
