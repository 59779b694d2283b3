"""Declarations: models, topics and what they publish. Plain Python, resolved when a plan is made."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from weirflow.functions import naming


class SpecError(ValueError):
    """A declaration that can't work."""


@dataclass(frozen=True)
class Relation:
    """A relation of a model: `key` is the foreign key, on the model itself for one, on the child for many."""

    name: str
    model: str
    key: str
    many: bool = False


@dataclass(frozen=True)
class ModelSpec:
    """One domain model, as producer and as consumer see it."""

    name: str
    attributes: tuple[str, ...] = ()
    relations: tuple[Relation, ...] = ()
    primary_key: str = "id"
    soft_delete_column: str | None = None
    publish_after_soft_delete: bool = False
    computed: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    # consumer side
    mapping: dict[str, str] = field(default_factory=dict)  # local name: remote name
    created_column: str | None = "synced_created_at"
    updated_column: str | None = "synced_updated_at"
    deleted_column: str | None = "synced_canceled_at"
    soft_delete: bool = True  # has the soft-delete action
    bulk: bool = False  # created and destroyed events bypass gate, diff and children

    @property
    def resource(self) -> str:
        return naming.underscore(self.name)

    def relation(self, name: str) -> Relation:
        for r in self.relations:
            if r.name == name:
                return r
        raise SpecError(f"{self.name} has no relation {name}")


@dataclass(frozen=True)
class Observation:
    """Changes of `attributes` of `model` publish the record reached by `path` from it ("a.b.c")."""

    model: str
    attributes: tuple[str, ...]
    path: str


@dataclass(frozen=True)
class Publication:
    model: str
    with_: tuple[str, ...] = ()  # relations embedded in the message
    observe: tuple[Observation, ...] = ()


@dataclass(frozen=True)
class Topic:
    namespace: str
    name: str
    publications: tuple[Publication, ...] = ()
    partition_key: str | Callable[[DataFrame], Column] | None = None
    genesis_replica: bool = False
    serialize: bool = True

    @property
    def full_name(self) -> str:
        return naming.topic_name(self.namespace, self.name)

    @property
    def replica_name(self) -> str:
        return naming.topic_name(self.namespace, self.name, replica=True)


OBSERVER_TOPIC = "__outbox_observer__"


@dataclass(frozen=True)
class Registry:
    models: dict[str, ModelSpec]
    topics: tuple[Topic, ...]

    def __post_init__(self):
        for t in self.topics:
            for p in t.publications:
                if p.model not in self.models:
                    raise SpecError(f"{t.full_name} publishes the unknown model {p.model}")
                for name in p.with_:
                    self.models[p.model].relation(name)
                for o in p.observe:
                    if not o.attributes or not o.path:
                        raise SpecError(f"{t.full_name}: an observation needs attributes and a path")
                    if o.model not in self.models:
                        raise SpecError(f"{t.full_name} observes the unknown model {o.model}")

    def publishing(self, model: str) -> list[Topic]:
        """Topics that publish the model itself."""
        return [t for t in self.topics if any(p.model == model for p in t.publications)]

    def _embedded(self, p: Publication) -> set[str]:
        return {self.models[p.model].relation(r).model for r in p.with_}

    def parents_of(self, model: str) -> list[tuple[Topic, str, Relation]]:
        """(topic, parent model, relation) for which the model is a dependency."""
        found = []
        for t in self.topics:
            for p in t.publications:
                for r in p.with_:
                    if self.models[p.model].relation(r).model == model:
                        found.append((t, p.model, self.models[p.model].relation(r)))
        return found

    def observations_of(self, model: str) -> list[tuple[Topic, str, Observation]]:
        """(topic, observer's model, observation) that look at the model; of one publication the first one only."""
        found = []
        for t in self.topics:
            for p in t.publications:
                own = [o for o in p.observe if o.model == model]
                if own:
                    found.append((t, p.model, own[0]))
        return found

    def outbox_topics(self, model: str) -> list[str]:
        """Topics of the outbox rows of a change: its own, those of its parents, and the observers' one; each once."""
        names = [t.full_name for t in self.publishing(model)] + [t.full_name for t, _, _ in self.parents_of(model)]
        if self.observations_of(model):
            names.append(OBSERVER_TOPIC)
        return list(dict.fromkeys(names))

    def mapping(self) -> list[tuple[str, str, str, list[str]]]:
        """(namespace, topic, model, embedded models) of every publication."""
        return [(t.namespace, t.full_name, p.model, sorted(self._embedded(p))) for t in self.topics for p in t.publications]

    def dim(self, spark: SparkSession) -> DataFrame:
        """The registry as a table: topic, model, kind (publishes, embeds, observes), genesis. One row per declaration."""
        rows = []
        for t in self.topics:
            for p in t.publications:
                rows.append((t.full_name, p.model, "publishes", t.genesis_replica))
                rows += [(t.full_name, m, "embeds", t.genesis_replica) for m in sorted(self._embedded(p))]
                rows += [(t.full_name, o.model, "observes", t.genesis_replica) for o in p.observe]
        return spark.createDataFrame(list(dict.fromkeys(rows)), "topic string, model string, kind string, genesis boolean")

    def check_replay(self, topic: Topic, model: str, genesis_only: bool = False) -> None:
        """Replay needs a model that the topic publishes itself, and a replica if nothing but the replica is to get it."""
        if not any(p.model == model for p in topic.publications):
            raise SpecError(f"{topic.full_name} doesn't publish {model} itself, so it can't be replayed there")
        if genesis_only and not topic.genesis_replica:
            raise SpecError(f"{topic.full_name} has no replica")

    def missing_columns(self, columns: dict[str, Iterable[str]]) -> list[str]:
        """Observed attributes that the tables (model: columns) don't have."""
        return [
            f"{o.model}.{a}"
            for t in self.topics
            for p in t.publications
            for o in p.observe
            for a in o.attributes
            if a not in set(columns.get(o.model, ()))
        ]
