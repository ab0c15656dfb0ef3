"""The queries; importing this package registers all of them."""

from pagewright.queries import filtering, labels, layouts, outcomes, outputs, shapes, texts

__all__ = ["filtering", "labels", "layouts", "outcomes", "outputs", "shapes", "texts"]
