"""Monthly panels, vintages and forecast evaluation as Spark DataFrame operators."""
