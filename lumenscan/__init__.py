"""lumenscan: exploratory analysis and data cleaning expressed as Spark plans."""
