"""fluvigrid: Spark-native analytics for gridded weather, stations and rivers."""
