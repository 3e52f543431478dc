"""The registered queries of the engine's own operators, over tables adapted to its data model."""
