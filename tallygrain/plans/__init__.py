"""Named queries. Importing a module registers its queries."""

from importlib import import_module

MODULES = [
    "sales",
    "relational",
    "changes",
    "documents",
    "streams",
    "orders",
    "scalars",
    "io",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"tallygrain.plans.{name}")
