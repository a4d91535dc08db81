"""pagewarden.sources"""
