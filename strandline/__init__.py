"""Spark-native interval, depth-segmentation and genotyping analytics, as DataFrame -> DataFrame operators."""
