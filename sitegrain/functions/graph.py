"""Entity graphs as pure data: entries of JSON-LD entities, roles and provenance.

An entry is a dict ``{"entity", "roles", "provenance"}``.  A :class:`Merger` takes
entries in order and keeps one per identity; what it could not reconcile is in
its ``conflicts``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from .paths import entity_id, parse_url, within_site

CONTEXT = "https://schema.org"
# Fixed values of the graph model.
ROLES = ("site", "page", "breadcrumbs", "mainEntity", "author", "publisher", "supporting")
SINGLETONS = ("site", "page", "breadcrumbs")
SOURCES = ("authored-jsonld", "authored-head", "configuration", "inference", "plugin", "api")
FORBIDDEN = ("__proto__", "prototype", "constructor")

# Properties of schema.org whose text is a URL.
URL_PROPERTIES = frozenset(
    """
    acquireLicensePage actionableFeedbackPolicy afterMedia archivedAt associatedDisease audio beforeMedia
    benefitsSummaryUrl codeRepository colleague colorSwatch constraintProperty contentUrl correctionsPolicy
    discussionUrl diseasePreventionInfo diseaseSpreadStatistics diversityPolicy diversityStaffingReport documentation
    downloadUrl duringMedia embedUrl ethicsPolicy gameLocation gettingTestedInfo hasGS1DigitalLink hasMap
    hasMolecularFunction healthPlanMarketingUrl image inCodeSet inDefinedTermSet installUrl isBasedOn isBasedOnUrl
    isInvolvedInBiologicalProcess isLocatedInSubcellularLocation isPartOf item labelDetails layoutImage license logo
    mainEntityOfPage map maps masthead merchantReturnLink missionCoveragePrioritiesPolicy newsUpdatesAndGuidelines
    noBylinesPolicy originalMediaLink paymentUrl prescribingInfo productReturnLink publicTransportClosuresInfo
    publishingPrinciples quarantineGuidelines relatedLink replyToUrl sameAs schoolClosuresInfo screenshot sdLicense
    season serviceUrl shippingSettingsLink significantLink significantLinks speakable target targetUrl thumbnailUrl
    tourBookingPage trackingUrl travelBans unnamedSourcesPolicy url usageInfo verificationFactCheckingPolicy video
    webFeed
    """.split()
)
# Properties of schema.org whose text may be a URL.
URL_OR_TEXT_PROPERTIES = frozenset(
    """
    acceptsReservations actionPlatform additionalType applicationCategory applicationSubCategory artMedium artform
    artworkSurface asin bankAccountType bodyType category childTaxon competencyRequired correction courseMode
    credentialCategory editEIDR educationalCredentialAwarded educationalLevel educationalProgramMode encodingFormat
    engineType featureList feesAndCommissionsSpecification fileFormat fuelType gamePlatform genre gtin hasMenu
    hasRepresentation identifier keywords knowsAbout legislationIdentifier loanType material measurementMethod
    measurementTechnique meetsEmissionStandard memoryRequirements menu namedPosition occupationalCredentialAwarded
    ownershipFundingInfo parentTaxon physicalRequirement propertyID releaseNotes requirements roleName schemaVersion
    securityClearanceRequirement sensoryRequirement softwareRequirements sport statType storageRequirements surface
    taxonRank taxonomicRange temporalCoverage termsOfService ticketToken titleEIDR unitCode usesHealthPlanIdStandard
    vehicleTransmission warning
    """.split()
)
BUILDERS = (
    "WebSite", "WebPage", "Person", "Organization", "Article", "BlogPosting", "BreadcrumbList", "ImageObject",
    "VideoObject", "Product", "SoftwareApplication", "Service", "Offer", "FAQPage", "HowTo", "Event", "LocalBusiness",
)


class GraphError(ValueError):
    """A graph that is not one."""


# -- JSON ----------------------------------------------------------------------


def strict(value: Any, depth: int = 0) -> Any:
    """A copy of strict JSON; ``GraphError`` for anything else."""
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise GraphError("numbers must be finite")
        return value
    if depth > 200:
        raise GraphError("nested too deeply")
    if isinstance(value, list):
        return [strict(v, depth + 1) for v in value]
    if isinstance(value, dict):
        if any(not isinstance(k, str) or k in FORBIDDEN for k in value):
            raise GraphError("unsafe key")
        return {k: strict(v, depth + 1) for k, v in value.items()}
    raise GraphError("not JSON")


def loads(text: str | None) -> Any:
    """Parse strict JSON; ``GraphError`` for what is none."""
    def bad(token: str) -> Any:
        raise GraphError(token)

    try:
        return strict(json.loads(text, parse_constant=bad))
    except (TypeError, ValueError, RecursionError) as error:
        raise GraphError("not JSON") from error


def stable(value: Any) -> str:
    """JSON with sorted keys: equal texts are equal values."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical(value: Any) -> Any:
    """Keys in order: ``@id``, ``@type``, the rest by code point; recursively."""
    if isinstance(value, list):
        return [canonical(v) for v in value]
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value, key=lambda k: (k != "@id", k != "@type", k))}
    return value


def child(pointer: str, key: str | int) -> str:
    return f"{pointer}/{str(key).replace('~', '~0').replace('/', '~1')}"


def serialize_text(value: Any) -> str:
    """JSON that may stand inside an HTML script."""
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    for char in "&<>\u2028\u2029":
        out = out.replace(char, f"\\u{ord(char):04x}")
    return out


# -- entities --------------------------------------------------------------------


def entity(value: Any) -> dict:
    """An entity: a JSON object without a context, and with sound keywords."""
    if not isinstance(value, dict) or "@context" in value:
        raise GraphError("an entity is an object without @context")
    out = strict(value)
    for _, node in _nodes(out):
        if "@id" in node and (not isinstance(node["@id"], str) or not node["@id"] or re.search(r"[\x00-\x1f\x7f]", node["@id"])):
            raise GraphError("@id must be a text")
        kind = node.get("@type")
        if "@type" in node and not (isinstance(kind, str) and kind or isinstance(kind, list) and kind and all(isinstance(t, str) and t for t in kind)):
            raise GraphError("@type must be a name or names")
    return out


def build(kind: str, fields: dict) -> dict:
    """An entity of one of the ``BUILDERS`` types."""
    if kind not in BUILDERS or "@type" in fields or "@context" in fields:
        raise GraphError("the builder owns @type and @context")
    return entity({"@type": kind, **fields})


def reference(target: str | dict) -> dict:
    found = target if isinstance(target, str) else target.get("@id")
    return entity({"@id": found})


def connect(source: dict, name: str, target: str | dict, replace: bool = False) -> dict:
    """A copy of ``source`` with one more reference, or with that one alone."""
    if name in ("@id", "@type", "@context", *FORBIDDEN):
        raise GraphError("not a relation")
    out, link = entity(source), reference(target)
    if replace or name not in out:
        return out | {name: link}
    held = out[name] if isinstance(out[name], list) else [out[name]]
    return out if link in held else out | {name: [*held, link]}


def types(value: dict) -> list[str]:
    kind = value.get("@type")
    return [t for t in (kind if isinstance(kind, list) else [kind]) if isinstance(t, str)]


def _nodes(value: Any, pointer: str = "") -> Iterator[tuple[str, dict]]:
    """All objects inside a value with their pointers, outermost first."""
    stack = [(pointer, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            yield at, v
            stack += [(child(at, k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(child(at, k), x) for k, x in reversed(list(enumerate(v)))]


def entry(value: Any) -> dict:
    """An entry from an entity, or from an object that has ``entity`` and no type."""
    if isinstance(value, dict) and "entity" in value and "@type" not in value:
        roles = value.get("roles") or []
        roles = list(dict.fromkeys(roles if isinstance(roles, list) else [roles]))
        provenance = value.get("provenance") or [{"source": "api"}]
        provenance = provenance if isinstance(provenance, list) else [provenance]
        if any(r not in ROLES for r in roles):
            raise GraphError("unknown role")
        for p in provenance:
            if not isinstance(p, dict) or p.get("source") not in SOURCES:
                raise GraphError("unknown provenance")
            if p.get("pointer") and not p["pointer"].startswith("/"):
                raise GraphError("not a pointer")
        keep = ("source", "pointer", "pathname", "sourcePath", "plugin")
        return {"entity": entity(value["entity"]), "roles": roles, "provenance": [{k: p[k] for k in keep if p.get(k) is not None} for p in provenance]}
    return {"entity": entity(value), "roles": [], "provenance": [{"source": "api"}]}


def entries(value: Any) -> list[dict]:
    """Entries of any graph input: an entry, a list, a JSON-LD document or a graph."""
    if isinstance(value, dict) and isinstance(value.get("entries"), list):
        return [entry(e) for e in value["entries"]]
    if isinstance(value, dict) and "@context" in value and "@graph" in value:
        if value["@context"] not in (CONTEXT, CONTEXT + "/") or not isinstance(value["@graph"], list):
            raise GraphError("the context must be schema.org")
        return [entry(e) for e in value["@graph"]]
    return [entry(e) for e in (value if isinstance(value, list) else [value])]


def authored(text: str) -> tuple[list[dict], list[str]]:
    """(entities, error codes) of a JSON-LD script; invalid nodes are left out one by one."""
    try:
        value = loads(text)
    except GraphError:
        return [], ["jsonld-invalid"]
    if isinstance(value, dict) and isinstance(value.get("@graph"), list):
        nodes = value["@graph"]
    elif isinstance(value, dict) and isinstance(value.get("entries"), list):
        nodes = [e.get("entity") if isinstance(e, dict) else e for e in value["entries"]]
    else:
        nodes = value if isinstance(value, list) else [value]
    good, bad = [], []
    for node in nodes:
        try:
            good.append(entity({k: v for k, v in node.items() if k != "@context"} if isinstance(node, dict) else node))
        except GraphError:
            bad.append("jsonld-invalid-node")
    return good, bad


# -- merging ---------------------------------------------------------------------


def inferred(provenance: list[dict]) -> bool:
    return bool(provenance) and all(p["source"] == "inference" for p in provenance)


def _of_pointer(provenance: list[dict], pointer: str) -> list[dict]:
    """Provenance that covers a pointer, or all of it if none does."""
    near = [p for p in provenance if "pointer" in p and (pointer == p["pointer"] or pointer.startswith(p["pointer"] + "/"))]
    return near or provenance


class Merger:
    """Folds entries, in order, into one per identity.

    Entries meet by ``@id``; else by a singleton role that both have with a type
    in common, if one of them is only inferred; else, without an id, by being
    equal.  Where a merge leaves a choice of id, an authored one is kept.
    """

    def __init__(self, policy: str = "error"):
        if policy not in ("error", "first", "last"):
            raise GraphError("unknown conflict policy")
        self.policy = policy
        self.entries: list[dict] = []
        self.conflicts: list[dict] = []
        self._by_id: dict[str, int] = {}
        self._anonymous: dict[str, int] = {}

    def add(self, raw: Any) -> None:
        new = entry(raw)
        side = (new["provenance"], new["provenance"], new["entity"].get("@id"), None)
        new["entity"] = self._tidy(new["entity"], "", side)
        own = new["entity"].get("@id")
        at, role = self._by_id.get(own) if own is not None else None, None
        if at is None:
            at, role = self._same_role(new)
        if at is None and own is None:
            at = self._anonymous.get(stable(new["entity"]))
        if at is None:
            self.entries.append(new)
            self._index(len(self.entries) - 1, new["entity"])
            return
        old = self.entries[at]
        name = self._name(old, new)
        first, second = (e["entity"] if name is None or e["entity"].get("@id") == name else e["entity"] | {"@id": name} for e in (old, new))
        merged = self._merge(first, second, "", (old["provenance"], new["provenance"], name, role))
        for gone in (old["entity"].get("@id"), own):
            if gone is not None and gone != name:
                self._by_id.pop(gone, None)
        if "@id" not in old["entity"]:
            self._anonymous.pop(stable(old["entity"]), None)
        provenance = {stable(p): p for p in [*old["provenance"], *new["provenance"]]}
        self.entries[at] = {"entity": merged, "roles": list(dict.fromkeys([*old["roles"], *new["roles"]])), "provenance": list(provenance.values())}
        self._index(at, merged)

    def _index(self, at: int, value: dict) -> None:
        if "@id" in value:
            self._by_id[value["@id"]] = at
        else:
            self._anonymous.setdefault(stable(value), at)

    @staticmethod
    def _name(old: dict, new: dict) -> str | None:
        mine, theirs = old["entity"].get("@id"), new["entity"].get("@id")
        if inferred(old["provenance"]) and not inferred(new["provenance"]) and theirs is not None:
            return theirs
        return mine if mine is not None else theirs

    def _same_role(self, new: dict) -> tuple[int | None, str | None]:
        for role in (r for r in new["roles"] if r in SINGLETONS):
            for at, old in enumerate(self.entries):
                if role in old["roles"] and set(types(old["entity"])) & set(types(new["entity"])):
                    if inferred(old["provenance"]) or inferred(new["provenance"]):
                        return at, role
                    break
        return None, None

    def _tidy(self, value: Any, pointer: str, side: tuple) -> Any:
        """Lists without repeated items; items of one id are merged."""
        if isinstance(value, dict):
            return {k: self._tidy(v, child(pointer, k), side) for k, v in value.items()}
        if not isinstance(value, list):
            return value
        out: list = []
        for item in value:
            self._put(out, self._tidy(item, child(pointer, len(out)), side), pointer, side)
        return out

    def _put(self, out: list, item: Any, pointer: str, side: tuple) -> None:
        name = item.get("@id") if isinstance(item, dict) else None
        for k, held in enumerate(out):
            if name is not None and isinstance(held, dict):
                if held.get("@id") == name:
                    out[k] = self._merge(held, item, child(pointer, k), side)
                    return
            elif stable(held) == stable(item):
                return
        out.append(item)

    def _merge(self, old: Any, new: Any, pointer: str, side: tuple) -> Any:
        if stable(old) == stable(new):
            return old
        if pointer.endswith("/@type"):
            names = list(dict.fromkeys(types({"@type": old}) + types({"@type": new})))
            return names[0] if len(names) == 1 else names
        if isinstance(old, dict) and isinstance(new, dict):
            both = {k: self._merge(old[k], new[k], child(pointer, k), side) if k in old else new[k] for k in new}
            return old | both
        if isinstance(old, list) and isinstance(new, list):
            out = list(old)
            for item in new:
                self._put(out, item, pointer, side)
            return out
        before, after, name, role = side
        guesses = inferred(_of_pointer(before, pointer)), inferred(_of_pointer(after, pointer))
        if guesses[0] != guesses[1]:
            return new if guesses[0] else old
        self.conflicts.append({"entity_id": name, "role": role, "pointer": pointer, "policy": self.policy, "resolution": "unresolved" if self.policy == "error" else self.policy})
        return new if self.policy == "last" else old


def merge(inputs: list, policy: str = "error") -> Merger:
    out = Merger(policy)
    for value in inputs:
        for e in entries(value):
            out.add(e)
    return out


# -- validation ------------------------------------------------------------------


def _finding(code: str, severity: str = "error", **where) -> dict:
    return {"code": f"schema.{code}", "severity": severity, "entity_id": where.get("entity_id"), "pointer": where.get("pointer")}


_URL_START = re.compile(r"(?i)(?:[a-z][a-z\d+.\-]*:|//|/|\./|\.\./|#|\?)")


def normalized(value: dict, base: str | None, found: list[dict]) -> dict:
    """Identifiers and URL-valued properties made absolute; the others reported."""

    def url(text: str, pointer: str, code: str) -> str:
        got = entity_id(text, base)
        if got is None:
            relative = code == "unsafe-url" and base is None and parse_url(text) is None and entity_id(text, "https://base.invalid/") is not None
            found.append(_finding("relative-url-base-missing" if relative else code, pointer=pointer))
        return got or text

    def walk(v: Any, pointer: str, kind: str | None) -> Any:
        if isinstance(v, list):
            return [walk(x, child(pointer, k), kind) for k, x in enumerate(v)]
        if isinstance(v, dict):
            is_url = "URL" in types(v)
            return {k: walk(x, child(pointer, k), _kind(k, is_url)) for k, x in v.items()}
        if not isinstance(v, str) or kind is None:
            return v
        if kind == "id":
            return url(v, pointer, "invalid-id")
        if kind == "text" and not (v.strip() and not re.search(r"\s", v.strip()) and _URL_START.match(v.strip())):
            return v
        return url(v, pointer, "unsafe-url")

    return walk(value, "", None)


def _kind(key: str, of_url: bool) -> str | None:
    if key == "@id":
        return "id"
    if key in URL_PROPERTIES or (of_url and key == "@value"):
        return "url"
    return "text" if key in URL_OR_TEXT_PROPERTIES else None


def references(value: dict, pointer: str = "") -> tuple[set[str], list[tuple[str, str]]]:
    """(ids defined, (id, pointer) referred to) by an entity."""
    defined, used = set(), []
    for at, node in _nodes(value, pointer):
        name = node.get("@id")
        if isinstance(name, str):
            if at == pointer or len(node) > 1:
                defined.add(name)
            else:
                used.append((name, child(at, "@id")))
    return defined, used


def validate(inputs: list, base: str | None = None, site: str | None = None, known: set[str] | None = None, strict_references: bool = True, policy: str = "error") -> tuple[Merger, list[dict]]:
    """(merged graph, findings): conflicts, roles, identifiers and references."""
    found: list[dict] = []
    try:
        graph = merge(inputs, policy)
        graph2 = Merger(policy)
        for e in graph.entries:
            graph2.add(e | {"entity": normalized(e["entity"], base, found)})
    except GraphError:
        return Merger(policy), [_finding("invalid-graph")]
    graph2.conflicts = graph.conflicts + graph2.conflicts
    for c in graph2.conflicts:
        solved = c["resolution"] != "unresolved"
        found.append(_finding("scalar-conflict" + "-resolved" * solved, "warning" if solved else "error", entity_id=c["entity_id"], pointer=c["pointer"]))
    for role in SINGLETONS:
        if sum(role in e["roles"] for e in graph2.entries) > 1:
            found.append(_finding("duplicate-role"))
    defined: set[str] = set()
    used: list[tuple[str, str]] = []
    for k, e in enumerate(graph2.entries):
        d, u = references(e["entity"], f"/entries/{k}/entity")
        defined |= d
        used += u
    document = base.split("#")[0] if base else None
    for name, pointer in used:
        if name in defined:
            continue
        full = entity_id(name, base)
        if full is None:
            found.append(_finding("invalid-reference", pointer=pointer))
            continue
        here = document is not None and full.split("#")[0] == document
        near = site is not None and within_site(full, site)
        if full in defined or (near and known is not None and full in known) or not (here or (near and known is not None)):
            continue
        found.append(_finding("unresolved-reference", "error" if strict_references else "warning", entity_id=full, pointer=pointer))
    return graph2, found


def document(graph: Merger) -> str:
    """A graph as a JSON-LD document."""
    return serialize_text({"@context": CONTEXT, "@graph": [canonical(e["entity"]) for e in graph.entries]})


# -- differences -----------------------------------------------------------------


def subtract(value: Any, known: Any) -> Any:
    """What ``value`` says beyond ``known``; ``None`` if nothing.

    Objects keep ``@id`` and ``@type`` if anything else is left of them.
    """
    if stable(value) == stable(known):
        return None
    if isinstance(value, dict) and isinstance(known, dict):
        out = {}
        for k, v in value.items():
            if k == "@id":
                continue
            if k == "@type":
                more = [t for t in types({k: v}) if t not in types({k: known.get(k)})]
                if more:
                    out[k] = more if len(more) > 1 else more[0]
                continue
            rest = subtract(v, known[k]) if k in known else v
            if rest is not None:
                out[k] = rest
        if not out:
            return None
        return {k: value[k] for k in ("@id", "@type") if k in value} | out
    if isinstance(value, list) and isinstance(known, list):
        held = {stable(v) for v in known}
        out = [v for v in value if stable(v) not in held]
        return out or None
    return value


def _identity(e: dict) -> str:
    return e["entity"].get("@id") or stable(e["entity"])


def diff(before: list[dict], after: list[dict]) -> list[dict]:
    """Operations that turn one list of entries into another, by identity."""
    old, new = ({_identity(entry(e)): entry(e) for e in side} for side in (before, after))
    out = [{"op": "remove", "id": k, "before": old[k]} for k in old if k not in new]
    out += [{"op": "update", "id": k, "before": old[k], "after": new[k]} for k in old if k in new and stable(old[k]) != stable(new[k])]
    return out + [{"op": "add", "id": k, "after": new[k]} for k in new if k not in old]


def patch(base: list[dict], operations: list[dict]) -> tuple[list[dict], list[str]]:
    """Apply operations where the base still is what they saw; (entries, conflicting ids).

    What another hand added to an entity since is kept if it is only an addition.
    """
    held = {_identity(entry(e)): entry(e) for e in base}
    bad: list[str] = []
    for op in operations:
        now = held.get(op["id"])
        if op["op"] == "add":
            if now is not None and stable(now) != stable(op["after"]):
                bad.append(op["id"])
            else:
                held[op["id"]] = op["after"]
        elif now is None:
            bad.append(op["id"])
        elif stable(now) == stable(op["before"]):
            if op["op"] == "remove":
                del held[op["id"]]
            else:
                held[op["id"]] = op["after"]
        else:
            extra = subtract(now["entity"], op["before"]["entity"]) if op["op"] == "update" else None
            clash = extra is None or any(k in op["after"]["entity"] and stable(op["after"]["entity"][k]) != stable(v) for k, v in extra.items() if k not in ("@id", "@type"))
            if clash:
                bad.append(op["id"])
            else:
                held[op["id"]] = op["after"] | {"entity": op["after"]["entity"] | extra}
    return list(held.values()), bad


def same(one: list[dict], two: list[dict]) -> bool:
    """Equal as multisets of entries; roles and provenance in any order."""

    def signature(e: dict) -> str:
        e = entry(e)
        return stable([e["entity"], sorted(e["roles"]), sorted(map(stable, e["provenance"]))])

    return sorted(map(signature, one)) == sorted(map(signature, two))


def reconcile(authored_before: str, authored_after: str, managed: list[dict], edited_managed: list[dict] | None, edited_whole: list[dict] | None) -> tuple[list[dict], list[str]]:
    """(managed entries, error codes) after a hook changed one of two views of a graph.

    Authored JSON-LD must be byte for byte what it was.  A changed managed view is
    taken; a changed whole view is taken less what authors say; both changed, and
    differing, is an error.
    """
    if authored_before != authored_after:
        return managed, ["managed-graph-authored-changed"]
    own, _ = authored(authored_before) if authored_before else ([], [])
    known = {e.get("@id"): e for e in own if "@id" in e}
    from_whole = None
    if edited_whole is not None:
        from_whole = []
        for e in map(entry, edited_whole):
            rest = subtract(e["entity"], known.get(e["entity"].get("@id"), {}))
            if rest is not None:
                from_whole.append(e | {"entity": rest})
    if edited_managed is not None and from_whole is not None and not same(edited_managed, from_whole):
        return managed, ["managed-graph-conflict"]
    out = edited_managed if edited_managed is not None else from_whole
    return (managed if out is None else [entry(e) for e in out]), []
