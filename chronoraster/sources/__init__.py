"""Readers and writers: scene folders, GeoTIFF, shapefile, Parquet sinks."""
