"""Semantic path definitions compiled into join plans that give shortcut edges between entities.

A path is a sequence of properties, a star meaning zero or more steps: `P108i/P9i*/P14/P107i*`. A step follows a property, its
sub-properties, and the inverses of both backwards. All paths move at once: a frontier (node, origin, at), where a node stands for the steps
taken, is joined with the moves of every property in one equi-join for each place in a path, whatever the number of relations.
A starred step joins the property's closure, which is computed once by squaring in log2(longest chain) rounds.
Paths that begin with the same steps share their nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Cut

#: paths with fewer steps than this aren't materialised
MIN_STEPS = 2


@dataclass(frozen=True)
class Relation:
    id: str
    label: str
    domain_fc: str
    range_fc: str
    paths: tuple[str, ...]


# All enabled relations of SURVEY Appendix A with their compact paths.
COMPACT = (
    Relation("thing_place_a", "refers to or is about", "Thing", "Place", ("P62/P89i*", "P67/P89i*", "P62/P53/P89i*", "P128/P67/P89i*", "P130*/P62/P89i*", "P130*/P67/P89i*", "P130*/P128/P67/P89i*", "P130i*/P62/P89i*", "P130i*/P67/P89i*", "P46*/P62/P89i*", "P46*/P128/P67/P89i*", "P106*/P67/P89i*", "P148*/P67/P89i*", "F1*/L11i/P9i*/L1/P62/P89i*")),
    Relation("thing_place_b", "is referred to at", "Thing", "Place", ("P67i/P94i/P9i*/P7/P89*", "P67i/P128i/P53/P89*", "P62i/P53/P89*", "P62i/P108i/P9i*/P7/P89*")),
    Relation("thing_place_c", "from (history)", "Thing", "Place", ("P53/P89*", "P54/P89*", "P92i/P9i*/P7/P89*", "P92i/P9i*/P14/P107i*/P74/P89*", "P92i/P9i*/P14/P107i*/P92i/P9i*/P7/P89*", "P25i/P26/P89*", "P25i/P27/P89*", "P12i/P9i*/P7/P89*", "P24i/P9i*/P7/P89*")),
    Relation("thing_place_c_created_in", "created in", "Thing", "Place", ("P92i/P9i*/P7/P89*",)),
    Relation("thing_place_c_found_acquired", "found or acquired at", "Thing", "Place", ("P12i/P9i*/P7/P89*", "P24i/P9i*/P7/P89*")),
    Relation("thing_place_c_by_person_from", "created by person from", "Thing", "Place", ("P92i/P9i*/P14/P107i*/P74/P89*", "P92i/P9i*/P14/P107i*/P92i/P7/P89*")),
    Relation("thing_place_c_located_in", "is/was located in", "Thing", "Place", ("P53/P89*",)),
    Relation("thing_place_c_moved_from", "moved from", "Thing", "Place", ("P25i/P27/P89*",)),
    Relation("thing_place_c_moved_to", "moved to", "Thing", "Place", ("P25i/P26/P89*",)),
    Relation("thing_thing_a", "has met", "Thing", "Thing", ("P46i*/P12i/P9i*/P12/P46*",)),
    Relation("thing_thing_b", "refers to or is about", "Thing", "Thing", ("P130*/P46*/P62/P46*", "P130*/P46*/P67/P46*", "P130*/P46*/P128/P67/P46*", "F1*/L11i/P9i*/L1/P46*")),
    Relation("thing_thing_c", "is referred to by", "Thing", "Thing", ("P46*/P67i/P148i*", "P46*/P67i/P128i/P46i*", "P46*/P62i/P46i*")),
    Relation("thing_thing_d", "from", "Thing", "Thing", ("P46i*", "P123i/P9i*/P124", "P31i/P9i*/P110", "P31i/P9i*/P112")),
    Relation("thing_thing_e", "has part", "Thing", "Thing", ("P46*", "P108i/P9i*/P111")),
    Relation("thing_thing_f", "is similar or same with", "Thing", "Thing", ("P130*", "P130i*", "L54i/L54")),
    Relation("thing_actor_a", "has met", "Thing", "Actor", ("P46i*/P12i/P9i*/P12/P107i*",)),
    Relation("thing_actor_b", "is referred to by", "Thing", "Actor", ("P67i/P94i/P9i*/P14/P107i*", "P67i/P128i/P46i*/P108i/P9i*/P14/P107i*", "P62i/P46i*/P108i/P9i*/P14/P107i*")),
    Relation("thing_actor_c", "refers to or is about", "Thing", "Actor", ("P130*/P62/P107*", "P130*/P67/P107*", "P130*/P128/P67/P107*")),
    Relation("thing_actor_d", "by", "Thing", "Actor", ("P92i/P9i*/P14/P107i*", "P16i/P9i*/P14/P107i*", "P31i/P9i*/P14/P107i*", "P12i/P9i*/P11/P107i*", "P24i/P22/P107i*", "P51/P107i*")),
    Relation("thing_actor_d_created_by", "created by", "Thing", "Actor", ("P92i/P9i*/P14/P107i*",)),
    Relation("thing_actor_d_used_by", "used by", "Thing", "Actor", ("P16i/P9i*/P14/P107i*",)),
    Relation("thing_actor_d_modified_by", "modified by", "Thing", "Actor", ("P31i/P9i*/P14/P107i*",)),
    Relation("thing_actor_d_found_acquired_by", "found or acquired by", "Thing", "Actor", ("P12i/P9i*/P11/P107i*", "P24i/P9i*/P14/P107i*", "P51/P107i*")),
    Relation("thing_actor_e", "from (keeper/owner)", "Thing", "Actor", ("P49/P107i*", "P51/P107i*")),
    Relation("thing_event_a", "refers to or is about", "Thing", "Event", ("P130*/P62/P9i*", "P130*/P67/P9i*", "P130*/P128/P67/P9i*", "F1*/L11i/P9i*/L1/P62/P9i*")),
    Relation("thing_event_b", "is referred to at", "Thing", "Event", ("P67i/P94i/P9i*", "P67i/P128i/P46i*/P108i/P9i*", "P62i/P108i/P9i*")),
    Relation("thing_event_c", "has met (from)", "Thing", "Event", ("P12i/P9i*",)),
    Relation("thing_event_c_destroyed_in", "destroyed in", "Thing", "Event", ("P93i/P9i*",)),
    Relation("thing_event_c_created_in", "created in", "Thing", "Event", ("P92i/P9i*",)),
    Relation("thing_event_c_modified_in", "modified in", "Thing", "Event", ("P31i/P9i*",)),
    Relation("thing_event_c_used_in", "used in", "Thing", "Event", ("P16i/P9i*",)),
    Relation("thing_event_c_digitized_in", "digitized in", "Thing", "Event", ("L1i/P9i*",)),
    Relation("thing_concept_a", "has type", "Thing", "Concept", ("P2/P127*", "P45/P127*", "P92i/P9i*/P33/P68", "P92i/P9i*/P126")),
    Relation("thing_concept_a_made_of", "is made of", "Thing", "Concept", ("P45", "P92i/P9i*/P33/P68")),
    Relation("place_place_c", "borders or overlaps with", "Place", "Place", ("P89i*/P122/P89*", "P89i*/P121/P89*")),
    Relation("place_thing_a", "refers to", "Place", "Thing", ("P89i*/P53i/P62", "P89i*/P53i/P128/P67", "P89i*/P74i/P51i/P62", "P89i*/P7i/P9*/P94/P67", "P89i*/P7i/P9*/P108/P62")),
    Relation("place_thing_b", "is referred to by", "Place", "Thing", ("P89*/P67i/P148i*", "P89*/P67i/P128i/P46i*", "P89*/P62i/P46i*")),
    Relation("place_thing_c", "has met", "Place", "Thing", ("P89i*/P53i/P46*", "P89i*/P7i/P9*/P92/P46*", "P89i*/P74i/P49i/P46*")),
    Relation("place_actor_a", "refers to", "Place", "Actor", ("P89i*/P53i/P62/P107*", "P89i*/P53i/P128/P67/P107*", "P89i*/P7i/P9*/P94/P67/P107*")),
    Relation("place_actor_b", "is referred to by", "Place", "Actor", ("P89*/P67i/P94i/P9i*/P14/P107*", "P89*/P62i/P46i*/P108i/P9i*/P14/P107*")),
    Relation("place_actor_c", "has met", "Place", "Actor", ("P89i*/P74i/P107*", "P89i*/P7i/P9*/P12/P107i*")),
    Relation("place_actor_c_origin_of", "is origin of", "Place", "Actor", ("P89i*/P7i/P9*/P98/P107*",)),
    Relation("place_event_a", "has met", "Place", "Event", ("P89i*/P7i/P9i*",)),
    Relation("place_event_b", "refers to", "Place", "Event", ("P89i*/P53i/P46*/P62/P9*", "P89i*/P53i/P46*/P128/P67/P9*")),
    Relation("place_event_c", "is referred to at", "Place", "Event", ("P89*/P67i/P130*/P94i/P9i*", "P89*/P67i/P128i/P46i*/P108i/P9i*", "P89*/P62i/P130*/P46i*/P108i/P9i*")),
    Relation("place_concept_a", "has type", "Place", "Concept", ("P89*/P2/P127*",)),
    Relation("actor_place_a", "refers to", "Actor", "Place", ("P107*/P14i/P9*/P92/P62/P89i*", "P107*/P14i/P9*/P92/P67/P89i*")),
    Relation("actor_place_b", "is referred to at", "Actor", "Place", ("P107i*/P67i/P94i/P9i*/P7/P89*", "P107i*/P67i/P128i/P46i*/P53/P89*", "P107i*/P62i/P46i*/P53/P89*", "P107i*/P62i/P46i*/P108i/P9i*/P7/P89*")),
    Relation("actor_place_c", "has met", "Actor", "Place", ("P107*/P12i/P9i*/P7/P89*", "P107*/P74/P89*")),
    Relation("actor_place_d", "from", "Actor", "Place", ("P107i*/P74/P89*", "P107i*/P92i/P9i*/P7/P89*")),
    Relation("actor_thing_a", "refers to", "Actor", "Thing", ("P107*/P14i/P9*/P92/P130*/P62", "P107*/P14i/P9*/P92/P130*/P128/P67")),
    Relation("actor_thing_b", "is referred to by", "Actor", "Thing", ("P107i*/P67i/P148i*", "P107i*/P67i/P128i/P46i*", "P107i*/P62i/P46i*")),
    Relation("actor_thing_c", "is origin of", "Actor", "Thing", ("P107*/P14i/P9*/P92/P46*", "P107*/P49i/P46*", "P107*/P51i/P46*")),
    Relation("actor_thing_d", "has met", "Actor", "Thing", ("P12i/P9*/P12",)),
    Relation("actor_actor_a", "refers to", "Actor", "Actor", ("P107*/P14i/P9*/P92/P130*/P62/P107*", "P107*/P14i/P9*/P92/P130*/P128/P67/P107*")),
    Relation("actor_actor_b", "has met", "Actor", "Actor", ("P107*/P12i/P9*/P12/P107i*",)),
    Relation("actor_actor_c", "is referred to by", "Actor", "Actor", ("P107i*/P67i/P94i/P9i*/P14/P107i*", "P107i*/P62i/P46i*/P108i/P9i*/P14/P107i*")),
    Relation("actor_actor_d", "from", "Actor", "Actor", ("P107i*/P98i/P97", "P107i*/P95i/P9*/P14/P107i*")),
    Relation("actor_actor_e", "is origin of", "Actor", "Actor", ("P107*/P97i/P98", "P107*/P14i/P9i*/P95/P107*")),
    Relation("actor_actor_f", "has member", "Actor", "Actor", ("P107*", "P144i/P143i/P107*")),
    Relation("actor_actor_g", "is member of", "Actor", "Actor", ("P107i*", "P143/P144/P107i*")),
    Relation("actor_event_a", "refers to", "Actor", "Event", ("P107*/P14i/P9*/P92/P130*/P62/P9*", "P107*/P14i/P9*/P92/P130*/P128/P67/P9*")),
    Relation("actor_event_b", "is referred to at", "Actor", "Event", ("P107i*/P67i/P94i/P9i*", "P107i*/P62i/P46i*/P108i/P9i*")),
    Relation("actor_event_c_from", "from", "Actor", "Event", ("P107i*/P95i/P9i*", "P98i/P9i*")),
    Relation("actor_event_d", "has met", "Actor", "Event", ("P107*/P12i/P9i*",)),
    Relation("actor_event_d_performed", "performed action at", "Actor", "Event", ("P107*/P14i/P9i*",)),
    Relation("actor_concept_a", "has type", "Actor", "Concept", ("P107i*/P2/P127*",)),
    Relation("event_place_a", "refers to", "Event", "Place", ("P9*/P92/P130*/P62/P89i*", "P9*/P92/P130*/P128/P67/P89i*")),
    Relation("event_place_b", "is referred to at", "Event", "Place", ("P9i*/P67i/P94i/P9i*/P7/P89*", "P9i*/P67i/P128i/P46i*/P53/P89*", "P9i*/P62i/P46i*/P53/P89*")),
    Relation("event_place_c", "from", "Event", "Place", ("P9i*/P7/P89*",)),
    Relation("event_thing_a", "refers to or is about", "Event", "Thing", ("P9*/P92/P130*/P62/P46*", "P9*/P92/P130*/P128/P67/P46*")),
    Relation("event_thing_b", "is referred to by", "Event", "Thing", ("P9i*/P67i/P130*/P148*", "P9i*/P62i/P130*/P46i*")),
    Relation("event_thing_c", "has met", "Event", "Thing", ("P9*/P12/P46*",)),
    Relation("event_thing_c_created", "created", "Event", "Thing", ("P9*/P92/P46*",)),
    Relation("event_thing_c_destroyed", "destroyed", "Event", "Thing", ("P9*/P93/P46*",)),
    Relation("event_thing_c_modified", "modified", "Event", "Thing", ("P9*/P31/P46*",)),
    Relation("event_thing_c_used", "used", "Event", "Thing", ("P9*/P16/P46*", "P9*/P125")),
    Relation("event_actor_a_refers", "refers to or is about", "Event", "Actor", ("P9*/P92/P130*/P62/P107*", "P9*/P92/P130*/P67/P107*", "P9*/P92/P130*/P128/P67/P107*")),
    Relation("event_actor_b", "is referred to by", "Event", "Actor", ("P9i*/P67i/P130*/P148*/P94i/P9i*/P14/P107i*", "P9i*/P62i/P130*/P46i*/P108i/P9i*/P14/P107i*")),
    Relation("event_actor_c", "by", "Event", "Actor", ("P9i*/P14/P107i*", "P9i*/P15/P107i*")),
    Relation("event_actor_d", "has met", "Event", "Actor", ("P9*/P12/P107i*",)),
    Relation("event_actor_d_brought_into_existence", "brought into existence", "Event", "Actor", ("P9*/P92/P107*",)),
    Relation("event_actor_d_took_out_of_existence", "took out of existence", "Event", "Actor", ("P9*/P93/P107*",)),
    Relation("event_event_a_refers", "refers to or is about", "Event", "Event", ("P9*/P92/P130*/P62/P9*", "P9*/P92/P130*/P67/P9*", "P9*/P92/P130*/P128/P67/P9*")),
    Relation("event_event_b", "is referred to at", "Event", "Event", ("P9*/P67i/P130*/P148*/P94i/P9i*", "P9*/P67i/P128i/P46i*/P108i/P9i*", "P9*/P62i/P130*/P46i*/P108i/P9i*")),
    Relation("event_concept_a", "has type", "Event", "Concept", ("P9*/P2/P127*",)),
    Relation("concept_place_a", "is type of", "Concept", "Place", ("P127i*/P2i/P89*",)),
    Relation("concept_thing_a", "is type of", "Concept", "Thing", ("P127i*/P2i/P46i*",)),
    Relation("concept_actor_a", "is type of", "Concept", "Actor", ("P127i*/P2i/P107i*",)),
    Relation("concept_event_a", "is type of", "Concept", "Event", ("P127i*/P2i/P9i*",)),
    Relation("event_time_a", "occurred at time", "Event", "Time", ("P4/P86*",)),
    Relation("thing_time_a", "has time", "Thing", "Time", ("P12i/P9i*/P4/P86*", "P24i/P9i*/P4/P86*")),
    Relation("thing_time_a_created", "was created at time", "Thing", "Time", ("P92i/P9i*/P4/P86*",)),
    Relation("thing_time_a_modified", "was modified at time", "Thing", "Time", ("P31i/P9i*/P4/P86*",)),
    Relation("thing_time_a_moved", "was moved at time", "Thing", "Time", ("P25i/P9i*/P4/P86*",)),
    Relation("thing_time_a_destroyed", "was destroyed at time", "Thing", "Time", ("P93i/P9i*/P4/P86*",)),
    Relation("actor_time_a", "participated at time", "Actor", "Time", ("P11i/P9i*/P4/P86*",)),
    Relation("actor_time_b", "was born or formed at time", "Actor", "Time", ("P92i/P9i*/P4/P86*",)),
    Relation("actor_time_b_born", "was born at time", "Actor", "Time", ("P98i/P9i*/P4/P86*",)),
    Relation("actor_time_c", "died or dissolved at time", "Actor", "Time", ("P93i/P9i*/P4/P86*",)),
    Relation("actor_time_c_died", "died at time", "Actor", "Time", ("P100i/P9i*/P4/P86*",)),
)
# Layers of paths that many relations share.
_COPY, _PART, _WHOLE = "{|P130*|P130i*}", "{|P46*|P106*|P148*}", "{|P46i*|P106i*|P148i*}"
_REFERS, _REFERRED = "{P62|P67|P128/P67}", "{P67i|P62i}"
_REFERS_PLACE = "{P62|P67|P128/P67|P62/P53|P67/P53|P128/P67/P53}"
_DIGITAL = "F1*/L11i/P9i*/L1"
_BY_PLACE = "{P53i/" + _REFERS + "|P7i/P9*/P94/P67|P7i/P9*/P108/" + _REFERS + "|P74i/{P49i|P51i}/" + _REFERS + "}"
_RECORDED = "{P94i/P9i*|P128i/P46i*/P108i/P9i*}"
_RECORDED_BY = "{P94i/P9i*/P14|P128i/P46i*/P108i/P9i*/P14}"
# The relations whose paths are all combinations of layers; these replace the compact paths.
LAYERED = {
    "thing_place_a": (f"{_COPY}/{_PART}/{_REFERS_PLACE}/{{|P89i*}}", f"{_DIGITAL}/{{P53|P62|P128/P67}}/{{|P89i*}}"),
    "thing_thing_b": (f"{_COPY}/{_PART}/{_REFERS}/{_PART}", f"{_DIGITAL}/{_PART}"),
    "thing_actor_c": (f"{_COPY}/{_PART}/{_REFERS}/{{|P107*}}",),
    "thing_event_a": (f"{_COPY}/{_PART}/{_REFERS}/{{|P9i*}}", f"{_DIGITAL}/{{P62|P128/P67}}/{{|P9i*}}"),
    "thing_thing_c": (f"{_COPY}/{_WHOLE}/{_REFERRED}/{{P148i*|P128i/P46i*}}",),
    "thing_place_b": (f"{_COPY}/{_WHOLE}/{_REFERRED}/{{P94i/P9i*/P7|P128i/P53|P128i/P108i/P9i*/P7}}/{{|P89*}}",),
    "thing_actor_b": (f"{_COPY}/{_WHOLE}/{_REFERRED}/{_RECORDED_BY}/{{|P107i*}}",),
    "thing_event_b": (f"{_COPY}/{_WHOLE}/{_REFERRED}/{{P94i/P9i*|P128i/P108i/P9i*}}",),
    "place_thing_a": (f"{{|P89i*}}/{_BY_PLACE}/{_PART}",),
    "place_actor_a": (f"{{|P89i*}}/{_BY_PLACE}/{{|P107*}}",),
    "place_event_b": ("{|P89i*}/P53i/{|P46*}/{P62|P128/P67}/{|P9*}",),
    "place_thing_b": (f"{{|P89*}}/{_COPY}/{_REFERRED}/{_RECORDED}",),
    "place_actor_b": (f"{{|P89*}}/{_COPY}/{_REFERRED}/{_RECORDED}",),
    "place_event_c": (f"{{|P89*}}/{_COPY}/{_REFERRED}/{_RECORDED}",),
    "actor_place_a": (f"{{|P107*}}/P14i/P9*/P92/{_COPY}/{_REFERS_PLACE}/{{|P89i*}}",),
    "actor_thing_a": (f"{{|P107*}}/P14i/P9*/P92/{_COPY}/{_REFERS}/{_PART}",),
    "actor_actor_a": (f"{{|P107*}}/P14i/P9*/P92/{_COPY}/{_REFERS}/{{|P107*}}",),
    "actor_event_a": (f"{{|P107*}}/P14i/P9*/P92/{_COPY}/{_REFERS}/{{|P9i*}}",),
    "actor_place_b": (f"{{|P107i*}}/{_COPY}/{_REFERRED}/{_RECORDED_BY}/P7/{{|P89*}}",),
    "actor_thing_b": (f"{{|P107i*}}/{_COPY}/{_REFERRED}/{_RECORDED_BY}",),
    "actor_actor_c": (f"{{|P107i*}}/{_COPY}/{_REFERRED}/{_RECORDED_BY}",),
    "actor_event_b": (f"{{|P107i*}}/{_COPY}/{_REFERRED}/{_RECORDED_BY}",),
    "event_place_a": (f"{{|P9*}}/P92/{_COPY}/{_PART}/{_REFERS_PLACE}/{{|P89i*}}",),
    "event_thing_a": (f"{{|P9*}}/P92/{_COPY}/{_PART}/{_REFERS}/{_PART}",),
    "event_actor_a_refers": (f"{{|P9*}}/P92/{_COPY}/{_REFERS}/{{|P107*}}",),
    "event_event_a_refers": (f"{{|P9*}}/P92/{_COPY}/{_REFERS}/{{|P9i*}}",),
    "event_place_b": (f"{{|P9i*}}/{_COPY}/{_REFERRED}/{_RECORDED}/P7/{{|P89*}}",),
    "event_thing_b": (f"{{|P9i*}}/{_COPY}/{_REFERRED}/{_RECORDED}",),
    "event_actor_b": (f"{{|P9i*}}/{_COPY}/{_REFERRED}/{_RECORDED}",),
    "event_event_b": (f"{{|P9i*}}/{_COPY}/{_REFERRED}/{_RECORDED}",),
    "thing_thing_d": (f"{{P46i*|P106i*|P148i*|P123i/P9i*/P124/{_WHOLE}|P31i/P9i*/{{P110|P112}}}}",),
    "thing_thing_e": ("{P46*|P106*|P148*|P108i/P9i*/P111}",),
    "event_thing_c": (f"{{|P9*}}/P12/{_PART}",),
    "event_thing_c_created": (f"{{|P9*}}/P92/{_PART}",),
    "event_thing_c_destroyed": (f"{{|P9*}}/P93/{_PART}",),
    "event_thing_c_modified": (f"{{|P9*}}/P31/{_PART}",),
    "event_thing_c_used": (f"{{|P9*}}/{{P16/{_PART}|P125}}",),
    "concept_thing_a": (f"{{|P127i*}}/P2i/{_WHOLE}",),
    "place_thing_c": (f"{{|P89i*}}/{{P53i/{{|P46*}}|P7i/P9*/P92/{_PART}|P74i/P49i/{{|P46*}}}}",),
    "actor_thing_c": (f"{{|P107*}}/{{P14i/P9*/P92/{_PART}|{{P49i|P51i}}/{{|P46*}}}}",),
}
# Relations not in layers that are stated for any object; rights and names are no origins (and no targets) of these.
OBJECT_DOMAIN = frozenset(
    "thing_place_c thing_place_c_created_in thing_place_c_by_person_from thing_thing_a thing_thing_f thing_actor_a thing_actor_d thing_actor_d_created_by thing_actor_d_used_by "
    "thing_event_c thing_event_c_destroyed_in thing_event_c_created_in thing_event_c_used_in thing_event_c_digitized_in thing_concept_a thing_concept_a_made_of".split()
)
OBJECT_RANGE = frozenset({"thing_thing_f"})


def layers(pattern: str) -> list[str]:
    """All paths of a pattern in which `{a|b|}` stands for one of its alternatives, maybe none; braces nest."""

    def alternatives(at: int) -> tuple[list[list[str]], int]:
        """Sequences of steps of the alternatives from position `at` up to the closing brace or the end."""
        done, open_, step = [], [[]], ""

        def closed(step):
            return [x + [step] for x in open_] if step else open_

        while True:
            c = pattern[at] if at < len(pattern) else "}"
            if c == "{":
                inner, at = alternatives(at + 1)
                open_ = [x + y for x in closed(step) for y in inner]
                step = ""
            elif c in "/|}":
                open_, step = closed(step), ""
                if c != "/":
                    done, open_ = done + open_, [[]]
                if c == "}":
                    return done, at + 1
                at += 1
            else:
                step, at = step + c, at + 1

    return ["/".join(x) for x in alternatives(0)[0]]


#: all enabled relations, those of LAYERED with all their combinations. Paths whose properties don't occur in an input fall out when they are compiled.
ENABLED = tuple(Relation(r.id, r.label, r.domain_fc, r.range_fc, tuple(p for x in LAYERED[r.id] for p in layers(x)) if r.id in LAYERED else r.paths) for r in COMPACT)
# Sub-property and super-property of the public ontology, by code.
SUB_PROPERTIES = (("P108", "P92"), ("P108i", "P92i"), ("P14", "P11"), ("P14i", "P11i"), ("P50", "P49"), ("P50i", "P49i"), ("P55", "P53"), ("P55i", "P53i"), ("P138", "P67"), ("P138i", "P67i"))


def inverse(code: str) -> str:
    return code[:-1] if code.endswith("i") else f"{code}i"


def family(code: str, subs: tuple[tuple[str, str], ...] = SUB_PROPERTIES) -> set[str]:
    """The property with all properties below it."""
    found, new = {code}, {code}
    while new:
        new = {a for a, b in subs if b in new} - found
        found |= new
    return found


def parse(path: str) -> list[tuple[str, bool]]:
    return [(step.rstrip("*"), step.endswith("*")) for step in path.split("/")]


def walkable(path: str, codes: set[str], subs: tuple[tuple[str, str], ...] = SUB_PROPERTIES) -> bool:
    """Whether a path of MIN_STEPS steps or more can lead anywhere over properties `codes`: the first step and all without a star need an edge."""

    def occurs(prop: str) -> bool:
        return not codes.isdisjoint(family(prop, subs) | {inverse(x) for x in family(prop, subs)})

    taken = parse(path)
    return len(taken) >= MIN_STEPS and occurs(taken[0][0]) and all(many or occurs(prop) for prop, many in taken)


# Properties between entities in the given tables.
GIVEN = set("P2 P4 P7 P9 P9i P14 P45 P46 P46i P50 P55 P62 P67 P72 P74 P89 P89i P104 P107 P107i P108i P122 P127 P127i P130 P138".split())
#: what of ENABLED can give rows over the given tables
CATALOGUE = tuple(Relation(r.id, r.label, r.domain_fc, r.range_fc, paths) for r in ENABLED if (paths := tuple(p for p in r.paths if walkable(p, GIVEN))))


def walks(relations: tuple[Relation, ...], codes: set[str], subs: tuple[tuple[str, str], ...] = SUB_PROPERTIES) -> list[tuple[Relation, tuple[tuple[str, bool], ...]]]:
    """(relation, ((property, starred), ...)): what is left of the paths over properties `codes`, each once.

    A star whose property doesn't occur stays where it is and falls out. So does a path that is another one of the relation without some of its stars
    beyond the first step, as the other one has all its rows.
    """
    out = []
    for r in relations:
        kept = {}
        for path in r.paths:
            if walkable(path, codes, subs):
                kept[tuple((prop, many) for prop, many in parse(path) if not codes.isdisjoint(family(prop, subs) | {inverse(x) for x in family(prop, subs)}))] = None
        less = {walk[:i] + walk[i + 1 :] for walk in kept for i in range(1, len(walk)) if walk[i][1]}
        while more := {walk[:i] + walk[i + 1 :] for walk in less for i in range(1, len(walk)) if walk[i][1]} - less:
            less |= more
        out += [(r, walk) for walk in kept if walk not in less]
    return out


def step0(relations: tuple[Relation, ...] = ENABLED, subs: tuple[tuple[str, str], ...] = SUB_PROPERTIES) -> set[str]:
    """Codes of the properties that begin a path, with those below them: what direct predicates leave out, as shortcuts tell it."""
    return {x for r in relations for path in r.paths if len(parse(path)) >= MIN_STEPS for x in family(parse(path)[0][0], subs)}


def code_of(p_key):
    """`p89i_contains` -> `P89i`; empty for other local names."""
    code = F.regexp_extract(p_key, r"^([a-z]\d+i?)_", 1)
    return F.concat(F.upper(F.substring(code, 1, 1)), F.substring(code, 2, 9))


def closure(pairs: DataFrame) -> DataFrame:
    """(prop, src, dst): one or more steps over the (src, dst) pairs of each prop; cycles end when nothing new is reached.

    Round k joins the pairs that are exactly 2^k steps apart with all that are 1 to 2^k apart, so log2(longest chain) rounds do for all
    properties together, and in a forest every pair is made once. Only new pairs are written.
    """
    leap = Cut(pairs.select("prop", "src", "dst").distinct())
    reached = [leap]
    while True:
        whole = reached[0].df
        for x in reached[1:]:
            whole = whole.unionByName(x.df)
        first = leap.df.select("prop", "src", F.col("dst").alias("via"))
        far = first.join(whole.select("prop", F.col("src").alias("via"), "dst"), ["prop", "via"]).select("prop", "src", "dst").distinct()
        new = Cut(far.join(whole, ["prop", "src", "dst"], "left_anti"))
        if new.df.isEmpty():
            new.drop()
            return whole
        reached.append(new)
        leap = Cut(first.join(leap.df.select("prop", F.col("src").alias("via"), "dst"), ["prop", "via"]).select("prop", "src", "dst").distinct())


def shortcuts(edges: DataFrame, vertices: DataFrame, relations: tuple[Relation, ...] = ENABLED, subs: tuple[tuple[str, str], ...] = SUB_PROPERTIES, left_out: DataFrame | None = None, no_objects: DataFrame | None = None) -> DataFrame:
    """(src, relation, dst): distinct shortcut edges from (src, dst, p_key) edges and (uri, fc) vertices.

    Origins have the relation's domain category and an edge of the path's first property, even if that step is starred; targets
    have its range category or none; an origin is never its own target. Paths of fewer than MIN_STEPS steps are left out. `left_out` (uri)
    are no origins, such as satellites; `no_objects` (uri) are neither origins nor targets of relations between any objects.
    """
    # numbers stand for URIs until the end: joins and sorts of the walk are on 8 bytes
    named = edges.select("src", "dst", code_of(F.col("p_key")).alias("code")).where("code <> ''").distinct()
    ends = named.select(F.explode(F.array("src", "dst")).alias("uri")).distinct().join(vertices.select("uri", "fc"), "uri", "left")
    ids = Cut(ends.select("uri", F.coalesce("fc", F.lit("")).alias("fc"), F.monotonically_increasing_id().alias("id")))
    number = lambda end: ids.df.select(F.col("uri").alias(end), F.col("id").alias(f"{end}_id"))
    coded = Cut(named.join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "code"))
    present = {r["code"] for r in coded.df.select("code").distinct().collect()}  # bounded by the ontology
    compiled = walks(relations, present, subs)
    if not compiled:
        return edges.select("src", F.lit("").alias("relation"), "dst").where("false")
    spark = edges.sparkSession
    props = sorted({prop for _, walk in compiled for prop, _ in walk})
    starred = {prop for _, walk in compiled for prop, many in walk if many}
    # the closure of an inverse is the closure read backwards
    once = [prop for prop in sorted(starred) if not (prop.endswith("i") and inverse(prop) in starred)]
    reading = [(x, prop, False) for prop in props for x in family(prop, subs)] + [(inverse(x), prop, True) for prop in props for x in family(prop, subs)]
    reading = F.broadcast(spark.createDataFrame(reading, "code string, prop string, back boolean"))  # bounded by the relations
    ends = (F.when(F.col("back"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("src", "dst"), ("dst", "src")))
    step = Cut(coded.df.join(reading, "code").select("prop", *ends).distinct())
    moves = step.df
    if once:
        reached = closure(step.df.where(F.col("prop").isin(once)))
        back = reached.where(F.col("prop").isin([inverse(x) for x in starred if x not in once]))
        turned = F.when(F.col("prop").endswith("i"), F.expr("substring(prop, 1, length(prop) - 1)")).otherwise(F.concat("prop", F.lit("i")))
        moves = moves.unionByName(reached.select(F.concat("prop", F.lit("*")).alias("prop"), "src", "dst"))
        moves = moves.unionByName(back.select(F.concat(turned, F.lit("*")).alias("prop"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    origins = ids.df if left_out is None else ids.df.join(left_out.select("uri").distinct(), "uri", "left_anti")

    # a node is a domain with the steps taken; all paths move at once, a join for each place in them
    nodes: dict[tuple, int] = {}
    last: dict[int, set] = {}
    for r, walk in compiled:
        for i in range(1, len(walk) + 1):
            nodes.setdefault((r.domain_fc, walk[:i]), len(nodes))
        last.setdefault(nodes[r.domain_fc, walk], set()).add((r.id, r.range_fc))
    stops = spark.createDataFrame([(n, *x) for n, found in last.items() for x in sorted(found)], "node int, relation string, range_fc string")

    def turns(depth: int) -> DataFrame | None:
        rows = [(domain, nodes.get((domain, taken[:-1]), -1), taken[-1][0] + "*" * taken[-1][1], taken[-1][1], n) for (domain, taken), n in nodes.items() if len(taken) == depth]
        return F.broadcast(spark.createDataFrame(rows, "fc string, node int, prop string, many boolean, child int")) if rows else None

    def stay(front: DataFrame, at: str) -> DataFrame:
        return front.where("many").select(F.col("child").alias("node"), "origin", F.col(at).alias("at"))

    begun = moves.join(turns(1), "prop").withColumnRenamed("src", "origin").join(origins.select(F.col("id").alias("origin"), "fc"), ["origin", "fc"])
    levels = [Cut(begun.select(F.col("child").alias("node"), "origin", F.col("dst").alias("at")).unionByName(stay(begun, "origin")).distinct())]
    while (ahead := turns(len(levels) + 1)) is not None:
        front = levels[-1].df.join(ahead, "node").select("child", "many", "origin", "prop", F.col("at").alias("src"))
        moved = front.join(moves, ["prop", "src"]).select(F.col("child").alias("node"), "origin", F.col("dst").alias("at"))
        levels.append(Cut(moved.unionByName(stay(front, "src")).distinct()))
    found = None
    for level in levels:
        some = level.df.join(F.broadcast(stops), "node").where("origin <> at").select("origin", "relation", "range_fc", "at")
        found = some if found is None else found.unionByName(some)
    to = ids.df.select(F.col("id").alias("at"), F.col("uri").alias("dst"), "fc")
    kept = found.distinct().join(to, "at").where((F.col("fc") == "") | (F.col("fc") == F.col("range_fc"))).select("origin", "relation", "dst")
    kept = kept.join(ids.df.select(F.col("id").alias("origin"), F.col("uri").alias("src")), "origin").select("src", "relation", "dst")
    if no_objects is not None:
        for end, barred_from in (("src", OBJECT_DOMAIN), ("dst", OBJECT_RANGE)):
            barred = no_objects.select(F.col("uri").alias(end), F.explode(F.array(*(F.lit(x) for x in sorted(barred_from)))).alias("relation")).distinct()
            kept = kept.join(barred, [end, "relation"], "left_anti")
    kept = Cut(kept.select("src", "relation", "dst"))
    for x in (ids, coded, step, *levels):
        x.drop()
    return kept.df


#: labels by relation
LABELS = {r.id: r.label for r in COMPACT}


def merged(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst, p_key, predicate_label, weight, edge_type): shortcuts with weight 1 and the edges that none of the same direction replaces."""
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    new = found.select("src", "dst", F.col("relation").alias("p_key"), F.coalesce(F.try_element_at(label, "relation"), "relation").alias("predicate_label"), F.lit(1.0).alias("weight"), F.lit("fr").alias("edge_type"))
    return uncovered(edges, found).withColumn("edge_type", F.lit("rdf")).select(*new.columns).unionByName(new)


def uncovered(edges: DataFrame, found: DataFrame) -> DataFrame:
    """The edges that no shortcut of the same direction replaces."""
    return edges.join(found.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*edges.columns)


# What an event of use has in its URI if it makes works.
MAKING = ("/creation", "/edition", "/impression")


def actor_works(edges: DataFrame) -> DataFrame:
    """(actor, works): distinct works by actor, from edges (src, dst, p_key, edge_type).

    Shortcuts from things to actors tell works directly; the plain edges left lead through events of production, or of use that make works, which the actor carried out.
    """
    direct = edges.where("edge_type = 'fr'").where(F.col("p_key").startswith("thing_actor")).select(F.col("dst").alias("actor"), F.col("src").alias("work"))
    plain = edges.where("edge_type = 'rdf'")
    made = F.col("p_key") == "p108i_was_produced_by"
    used = (F.col("p_key") == "p16i_was_used_for") & F.col("dst").rlike("|".join(MAKING))
    works = plain.where(made | used).select(F.col("src").alias("work"), F.col("dst").alias("event"))
    by = plain.where("p_key = 'p14_carried_out_by'").select(F.col("src").alias("event"), F.col("dst").alias("actor"))
    by = by.unionByName(plain.where("p_key = 'p14i_performed'").select(F.col("dst").alias("event"), F.col("src").alias("actor")))
    return direct.unionByName(works.join(by, "event").select("actor", "work")).distinct().groupBy("actor").agg(F.count("*").alias("works"))


def summaries(found: DataFrame, shown: int = 50) -> DataFrame:
    """(relation, connections, sources, targets, top_sources, top_targets): totals and the ends with most connections, `uri=n` joined by blanks.

    Both ends are counted first; totals and the best are read off the counts, so no distinct count sees the connections themselves.
    """
    sides = {}
    for end, name in (("src", "sources"), ("dst", "targets")):
        counts = found.groupBy("relation", F.col(end).alias("uri")).agg(F.count("*").alias("n"))
        order = [F.col("n").desc(), F.col("uri")]
        few = counts.withColumn("r", F.row_number().over(W.partitionBy("relation", F.pmod(F.xxhash64("uri"), F.lit(64))).orderBy(*order))).where(F.col("r") <= shown)
        few = few.withColumn("r", F.row_number().over(W.partitionBy("relation").orderBy(*order))).where(F.col("r") <= shown)
        top = few.groupBy("relation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "uri", "n"))), lambda x: F.concat(x["uri"], F.lit("="), x["n"])), " ").alias(f"top_{name}"))
        sides[name] = counts.groupBy("relation").agg(F.sum("n").alias("connections"), F.count("*").alias(name)).join(top, "relation")
    return sides["sources"].join(sides["targets"].drop("connections"), "relation").select("relation", "connections", "sources", "targets", "top_sources", "top_targets")


def listed(found: DataFrame, shown: int = 10) -> DataFrame:
    """(src, relation, total, targets): all targets counted, the `shown` smallest listed, joined by blanks."""
    totals = found.groupBy("src", "relation").agg(F.count("*").alias("total"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(64)))
    few = salted.withColumn("r", F.row_number().over(W.partitionBy("src", "relation", "salt").orderBy("dst"))).where(F.col("r") <= shown)
    few = few.withColumn("r", F.row_number().over(W.partitionBy("src", "relation").orderBy("dst"))).where(F.col("r") <= shown)
    return totals.join(few.groupBy("src", "relation").agg(F.array_join(F.sort_array(F.collect_list("dst")), " ").alias("targets")), ["src", "relation"])


def overlapping(found: DataFrame, share: float = 0.8) -> DataFrame:
    """(src, relation_a, relation_b, common): relations of one source whose targets agree in more than `share` of the fewer ones.

    Common targets are counted by joining on (src, dst), where a pair has at most as many rows as there are relations.
    """
    sizes = found.groupBy("src", "relation").agg(F.count("*").alias("n"))
    a = found.select("src", "dst", F.col("relation").alias("relation_a"))
    b = found.select("src", "dst", F.col("relation").alias("relation_b"))
    common = a.join(b, ["src", "dst"]).where("relation_a < relation_b").groupBy("src", "relation_a", "relation_b").agg(F.count("*").alias("common"))
    both = common.join(sizes.select("src", F.col("relation").alias("relation_a"), F.col("n").alias("na")), ["src", "relation_a"]).join(sizes.select("src", F.col("relation").alias("relation_b"), F.col("n").alias("nb")), ["src", "relation_b"])
    return both.where(F.col("common") > share * F.least("na", "nb")).select("src", "relation_a", "relation_b", "common")
