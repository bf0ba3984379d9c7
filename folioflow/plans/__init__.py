"""Queries over the driver's tables; importing a module registers its queries."""

from folioflow.plans import emit, filters, flow, html, layout, layouts, properties, scalars, sources, structure, trees, words  # noqa: F401
