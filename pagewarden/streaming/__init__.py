"""pagewarden.streaming"""
