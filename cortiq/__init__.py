"""Spark-native analysis of brain-imaging tables: signals, designs, meshes, neighborhoods and resampling plans."""
