"""lorespark.streaming"""
