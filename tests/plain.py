"""Plain Python forms of what the engine says of content and bundles, to hold it against."""

import base64
import binascii
import hashlib

from factgraph.functions.canon import canonical, cut_bytes, format_number, strings
from factgraph.functions.flatten import LABEL_FIELDS, LISTED
from factgraph.sources.bundles import NO_BIRTH, NO_LANGUAGE, NO_TIME, NOTE_FIELDS, SOURCE_SYSTEM, TIMES


def codings(value) -> list[tuple[str, str]]:
    """(system, code) of every `coding` list at any depth."""
    found, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            listed = v.get("coding")
            for c in listed if isinstance(listed, list) else []:
                if isinstance(c, dict) and all(isinstance(c.get(k), str) and c[k] for k in ("system", "code")):
                    found.append((c["system"], c["code"]))
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return found


def concept_label(concept) -> str:
    """Text of a concept, else display or code of its first coding, '' for any other shape."""
    if not isinstance(concept, dict):
        return ""
    listed = concept.get("coding")
    first = listed[0] if isinstance(listed, list) and listed and isinstance(listed[0], dict) else {}
    return next((x for x in (concept.get("text"), first.get("display"), first.get("code")) if isinstance(x, str) and x), "")


def measured(content: dict) -> str:
    """Number and unit of a quantity, or the label of a coded value; a unit without a number doesn't count."""
    q = content.get("valueQuantity")
    number = q.get("value") if isinstance(q, dict) else None
    if isinstance(number, (int, float)) and not isinstance(number, bool):
        unit = q.get("unit")
        return format_number(number) + (f" {unit}" if isinstance(unit, str) and unit else "")
    return concept_label(content.get("valueCodeableConcept"))


def _lines(text: str) -> list[str]:
    return [s for s in (x.strip() for x in text.split("\n")) if s]


def summary(kind: str, content) -> str:
    content = content if isinstance(content, dict) else {}
    if kind == "clinical_note":
        raw = content.get("raw_text")
        rows = _lines(raw) if isinstance(raw, str) else []
        return cut_bytes(next((r for r in rows if r.startswith("#")), rows[0] if rows else ""), 200)
    named = content.get(LABEL_FIELDS.get(kind, ""))
    if kind in LISTED:
        named = named[0] if isinstance(named, list) and named else None
    label = concept_label(named)
    if label:
        value = measured(content) if kind == "fhir_observation" else ""
        return f"{kind}: {cut_bytes(' '.join(x for x in (label, value) if x), 200)}"
    words = sorted(strings(content), key=str.encode)
    return f"{kind}: {cut_bytes(words[0], 200)}" if words else kind


def search_text(kind: str, content) -> str:
    raw = content.get("raw_text") if isinstance(content, dict) else None
    if kind == "clinical_note":
        return raw if isinstance(raw, str) else ""
    return " ".join(sorted(strings(content), key=str.encode))


def render(kind: str, content, level: int) -> str:
    """A fact at one of three levels of detail: all content, its first string, nothing but a reference."""
    if level == 0:
        body = canonical(content if content is not None else {})
        for c, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
            body = body.replace(c, code)
        return f"{kind}: {body}"
    if level == 1:
        words = sorted(strings(content), key=str.encode)
        return f"{kind}: {cut_bytes(words[0], 160)}" if words else kind
    return ""


def _at(value, *path):
    """What a path of keys and indices leads to, None where it doesn't."""
    for p in path:
        if isinstance(p, int):
            value = value[p] if isinstance(value, list) and len(value) > p else None
        else:
            value = value.get(p) if isinstance(value, dict) else None
    return value


def _text(value, default=None):
    return value if isinstance(value, str) and value else default


def resource_time(resource: dict) -> str:
    found = (_text(_at(resource, *field.split("."))) for field in TIMES.get(resource.get("resourceType"), ()))
    return next((t for t in found if t), NO_TIME)


def encounter_of(resource: dict) -> tuple[str | None, str | None]:
    """(reference, warning): the resource's own encounter, else the first that its context lists."""
    direct = _text(_at(resource, "encounter", "reference"))
    if direct:
        return direct, None
    listed = _at(resource, "context", "encounter")
    nested = _text(_at(listed, 0, "reference"))
    many = nested and len(listed) > 1
    return nested, f"{len(listed)} encounters listed, the first is taken" if many else None


def patient_content(patient: dict) -> dict:
    entry = _at(patient, "name", 0) or {}
    family = entry.get("family", "") if isinstance(entry, dict) else ""
    family = (family[0] if family else "") if isinstance(family, list) else family
    name = f"{_at(entry, 'given', 0) or ''} {family or ''}".strip() or "Unknown"
    return patient | {"fhir_id": patient.get("id", ""), "name": name, "gender": patient.get("gender")}


def note_content(resource: dict, source_system: str = SOURCE_SYSTEM) -> dict:
    """A note keeps its decoded text and no codes: those of a document's kind are not findings."""
    attachment = _at(resource, "content", 0, "attachment")
    try:
        raw = base64.b64decode(_text(_at(attachment, "data"), "")).decode()
    except (binascii.Error, ValueError):
        raw = ""
    kind = _text(_at(resource, "type", "coding", 0, "code"))
    values = (raw, source_system, resource.get("id", ""), _text(_at(attachment, "language"), NO_LANGUAGE), resource.get("status", ""), kind)
    return {k: v for k, v in zip(NOTE_FIELDS, values) if v is not None}


def _entries(bundle) -> list[tuple[str | None, dict]]:
    listed = _at(bundle, "entry")
    return [(_text(_at(e, "fullUrl")), e["resource"]) for e in (listed if isinstance(listed, list) else []) if isinstance(_at(e, "resource"), dict)]


def _is_old_note(resource: dict) -> bool:
    return resource.get("resourceType") == "DocumentReference" and resource.get("status") != "current"


def map_bundle(bundle) -> list[dict]:
    """The facts of a decoded bundle in the order in which they are appended."""
    return [fact for fact, _ in map_contents(bundle)]


def map_contents(bundle) -> list[tuple[dict, dict]]:
    """The facts of a decoded bundle in the order in which they are appended, each with its decoded content."""
    entries = _entries(bundle)
    patient = next(((u, r) for u, r in entries if r.get("resourceType") == "Patient"), None)
    if patient is None:
        return []
    medications = {k: r for u, r in entries if r.get("resourceType") == "Medication" for k in (u, r.get("id")) if k}
    facts: list[dict] = []
    contents: list[dict] = []
    known: dict[str, tuple[str, str]] = {}  # a reference: fact id, resource id

    def add(url, resource, kind, ts, content, parent, fallback=False, warning=None):
        parents = [parent[0]] if parent else []
        text = canonical(content)
        fact_id = hashlib.sha256(f'{{"amends":[],"content":{text},"parents":{canonical(parents)},"retracts":[],"timestamp":{canonical(ts)},"type":{canonical(kind)}}}'.encode()).hexdigest()
        ref = str(resource.get("id", ""))
        known.update({k: (fact_id, ref) for k in (url, ref) if k})
        facts.append({"append_seq": len(facts) + 1, "fact_id": fact_id, "type": kind, "ts": ts, "parents": parents, "patient_root": facts[0]["fact_id"] if facts else fact_id, "content": text, "fhir_id": ref, "fhir_type": resource.get("resourceType"), "parent_fhir_id": parent[1] if parent else None, "parent_fallback": fallback, "warning": warning})
        contents.append(content)

    add(*patient, "patient_registration", _text(patient[1].get("birthDate"), NO_BIRTH), patient_content(patient[1]), None)
    root = (facts[0]["fact_id"], facts[0]["fhir_id"])
    wanted = [(u, r) for u, r in entries if r.get("resourceType") in TIMES and not _is_old_note(r)]
    for url, r in sorted(wanted, key=lambda x: (x[1]["resourceType"] != "Encounter", resource_time(x[1]), str(x[1].get("id", "")))):
        rtype, ref, warning = r["resourceType"], None, None
        if rtype != "Encounter":
            ref, warning = encounter_of(r)
        content = note_content(r) if rtype == "DocumentReference" else r
        if rtype == "MedicationRequest" and "medicationCodeableConcept" not in r:
            code = _at(medications.get(_text(_at(r, "medicationReference", "reference"))), "code")
            content = r | {"medicationCodeableConcept": code} if isinstance(code, dict) else r
        kind = "clinical_note" if rtype == "DocumentReference" else "fhir_" + rtype.lower()
        add(url, r, kind, resource_time(r), content, known.get(ref, root), bool(ref) and ref not in known, warning)
    return list(zip(facts, contents))
