"""lorespark.sources"""
